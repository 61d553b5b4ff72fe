"""Fingerprints of plans: SHA-256 over a canonical form that does not depend on operand order."""

from __future__ import annotations

import hashlib

from postern.plans.nodes import All, And, Empty, Exact, OneOf, Or, Plan, Range


def canonical(plan: Plan) -> str:
    match plan:
        case All() | Empty():
            return type(plan).__name__
        case Exact(index, value):
            return f"Exact({index.scope!r},{value!r})"
        case OneOf(index, values):
            return f"OneOf({index.scope!r},{values!r})"
        case Range(index, low, low_in, high, high_in):
            return f"Range({index.scope!r},{low!r},{low_in},{high!r},{high_in})"
        case And(parts) | Or(parts):
            return f"{type(plan).__name__}({','.join(sorted(canonical(p) for p in parts))})"
    raise TypeError(plan)


def fingerprint(plan: Plan, schema_fingerprint: bytes = b"") -> bytes:
    return hashlib.sha256(schema_fingerprint + canonical(plan).encode()).digest()
