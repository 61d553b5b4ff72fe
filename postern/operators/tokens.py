"""Continuation tokens: sealed, bound to what they continue, and checked before they are used.

The payload is sealed by AES-GCM in the driver's Java machine; neither key nor payload gets into a plan, and
no job runs.  The provider, the kind of page, the
query, the schema, the layout epoch and the page policy are bound into it: a token that cannot be
opened is invalid, one that opens but belongs to something else is stale.
"""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from postern.errors import InvalidArgumentError, InvalidContinuationError, StaleContinuationError

VERSION = 1
#: Bytes of the random number that each token begins with.
NONCE = 12


@dataclass(frozen=True)
class KeyRing:
    """Keys by id, of 16, 24 or 32 bytes; new tokens are sealed under the current one."""

    keys: dict[str, bytes]
    current: str

    def __post_init__(self) -> None:
        if self.current not in self.keys:
            raise InvalidArgumentError(f"there is no key {self.current!r}")
        if any(len(k) not in (16, 24, 32) for k in self.keys.values()):
            raise InvalidArgumentError("keys have 16, 24 or 32 bytes")
        if any("." in name or not name for name in self.keys):
            raise InvalidArgumentError("key ids are not empty and have no dot")


@dataclass(frozen=True)
class Binding:
    provider: str
    family: str
    query: str
    ordering: str
    epoch: int
    policy: str

    def fields(self) -> dict[str, Any]:
        return {"p": self.provider, "f": self.family, "q": self.query, "o": self.ordering, "e": self.epoch, "y": self.policy}


class TokenCodec:
    def __init__(self, spark: SparkSession, ring: KeyRing, most_bytes: int = 2048) -> None:
        self.spark, self.ring, self.most_bytes = spark, ring, most_bytes

    def _aad(self, key_id: str) -> bytes:
        return f"postern-token-{VERSION}/{key_id}".encode()

    @cached_property
    def _java(self) -> tuple[Any, Any, Any, Any, Any]:
        """The cipher, its two modes and the kinds of its arguments; each look-up of a name asks the Java machine."""
        crypto = self.spark.sparkContext._jvm.javax.crypto
        return crypto.Cipher, crypto.Cipher.ENCRYPT_MODE, crypto.Cipher.DECRYPT_MODE, crypto.spec.SecretKeySpec, crypto.spec.GCMParameterSpec

    def _cipher(self, encrypt: bool, key_id: str, nonce: bytes) -> Any:
        modes, seal, unseal, key_spec, nonce_spec = self._java
        cipher = modes.getInstance("AES/GCM/NoPadding")
        cipher.init(seal if encrypt else unseal, key_spec(bytearray(self.ring.keys[key_id]), "AES"), nonce_spec(128, bytearray(nonce)))
        cipher.updateAAD(bytearray(self._aad(key_id)))
        return cipher

    def protect(self, binding: Binding, position: Any) -> str:
        body = json.dumps(binding.fields() | {"v": VERSION, "at": position}, sort_keys=True, separators=(",", ":")).encode()
        key_id, nonce = self.ring.current, os.urandom(NONCE)
        sealed = nonce + bytes(self._cipher(True, key_id, nonce).doFinal(bytearray(body)))
        token = f"{key_id}.{base64.urlsafe_b64encode(sealed).decode().rstrip('=')}"
        if len(token) > self.most_bytes:
            raise InvalidArgumentError(f"a token of {len(token)} bytes; at most {self.most_bytes} are allowed")
        return token

    def unprotect(self, token: str, binding: Binding) -> Any:
        """The position in the token."""
        if not isinstance(token, str) or not token or len(token) > self.most_bytes:
            raise InvalidContinuationError("not a token")
        key_id, dot, rest = token.partition(".")
        if not dot or key_id not in self.ring.keys:
            raise InvalidContinuationError("not a token under a known key")
        try:
            sealed = base64.b64decode(rest + "=" * (-len(rest) % 4), altchars=b"-_", validate=True)
        except ValueError:
            raise InvalidContinuationError("not a token") from None
        if len(sealed) <= NONCE:
            raise InvalidContinuationError("not a token")
        try:
            opened = self._cipher(False, key_id, sealed[:NONCE]).doFinal(bytearray(sealed[NONCE:]))
        except Py4JJavaError as e:
            if "javax.crypto" not in e.java_exception.getClass().getName():
                raise
            raise InvalidContinuationError("the token does not open") from None
        body = json.loads(bytes(opened))
        if body.get("v") != VERSION:
            raise InvalidContinuationError("a token of another version")
        wrong = [k for k, v in binding.fields().items() if body.get(k) != v]
        if wrong:
            raise StaleContinuationError(f"the token belongs to something else ({', '.join(wrong)})")
        return body["at"]
