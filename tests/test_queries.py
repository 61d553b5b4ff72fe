"""Terminals over a small state: identifiers, pages, tokens and facets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postern import workload
from postern.errors import ArgumentRangeError, InvalidArgumentError, InvalidContinuationError, QueryLimitError, SchemaError, StaleContinuationError, UnsupportedQueryError
from postern.limits import QueryOptions
from postern.operators import hydrate
from postern.operators.providers import FacetProvider, IdentifierProvider, PageProvider
from postern.operators.query import find_df, range_df
from postern.operators.tokens import Binding, KeyRing, TokenCodec
from postern.plans.predicate import P
from postern.sources.namespace import Namespace
from postern.sources.schema import StateSchema
from postern.sources.table import Table

ROWS = [(f"k{i:03d}", ["Oslo", "London", None][i % 3], i % 7, i % 2 == 0, [f"t{i % 5}", "all"]) for i in range(60)]


@pytest.fixture(scope="module")
def ns(spark):
    data = spark.createDataFrame(ROWS, "key string, city string, rank int, open boolean, tags array<string>").cache()
    space = Namespace(spark, "demo", options=QueryOptions(page_size=7))
    space.bind(StateSchema.of("place", "key", data, city="hash", rank="range", open="hash", tags="hash"), data)
    return space


def brute(keep):
    return sorted(r[0] for r in ROWS if keep(r))


def test_ids_are_sorted_and_distinct(ns):
    q = ns.query("place").where((P.city == "Oslo") & (P.rank > 2))
    assert q.ids() == brute(lambda r: r[1] == "Oslo" and r[2] > 2)
    assert ns.query("place").where((P.city == "Oslo") | (P.rank < 3)).ids() == brute(lambda r: r[1] == "Oslo" or r[2] < 3)
    assert ns.query("place").where(P.tags.contains("t1") & P.tags.contains("all")).ids() == brute(lambda r: "t1" in r[4])


@pytest.mark.parametrize("lo_in", [True, False])
@pytest.mark.parametrize("hi_in", [True, False])
def test_range_ends(ns, lo_in, hi_in):
    got = [r[0] for r in range_df(ns, "place", "rank", 2, 5, lo_in, hi_in).collect()]
    assert got == brute(lambda r: (r[2] > 2 or (lo_in and r[2] == 2)) and (r[2] < 5 or (hi_in and r[2] == 5)))


def test_direct_finds_check_their_arguments(ns):
    assert [r[0] for r in find_df(ns, "place", "city", "Oslo").collect()] == brute(lambda r: r[1] == "Oslo")
    with pytest.raises(InvalidArgumentError):
        range_df(ns, "place", "rank", 5, 2)
    with pytest.raises(InvalidArgumentError):
        range_df(ns, "place", "city", "a", "b")
    with pytest.raises(InvalidArgumentError):
        find_df(ns, "place", "city", None)
    assert range_df(ns, "place", "rank", 3, 3, True, False).count() == 0


def test_pages_concatenate_to_the_whole(ns):
    q = ns.query("place").where(P.rank >= 1)
    pages = list(q.pages(8))
    assert [k for p in pages for k in p.items] == q.ids()
    assert all(len(p.items) == 8 for p in pages[:-1]) and pages[-1].token is None
    one = ns.query("place").where(P.rank == 6)
    exact = one.page(len(one.ids()))
    assert exact.token is None


def test_tokens_are_bound(ns):
    q = ns.query("place").where(P.rank >= 1)
    token = q.page(5).token
    assert q.page(5, token).items == q.ids()[5:10]
    with pytest.raises(StaleContinuationError):
        q.page(6, token)
    with pytest.raises(StaleContinuationError):
        ns.query("place").where(P.rank >= 2).page(5, token)
    with pytest.raises(StaleContinuationError):
        ns.query("place").where(P.rank >= 1).distinct_page("rank", 5, token)
    for bad in ("", "x", "local.AAAA", token[:-4] + "AAAA", "other." + token.split(".")[1], "local.*" + token):
        with pytest.raises(InvalidContinuationError):
            q.page(5, bad)


def test_key_rotation(spark, ns):
    old = KeyRing({"a": b"0" * 32}, "a")
    both = KeyRing({"a": b"0" * 32, "b": b"1" * 16}, "b")
    first = Namespace(spark, "demo", keys=old)
    second = Namespace(spark, "demo", keys=both)
    for s in (first, second):
        s.bind(ns.schema("place"), ns.data("place"))
    token = first.query("place").where(P.rank >= 0).page(5).token
    assert second.query("place").where(P.rank >= 0).page(5, token).items == [f"k{i:03d}" for i in range(5, 10)]
    with pytest.raises(InvalidContinuationError):
        Namespace(spark, "demo", keys=KeyRing({"b": b"1" * 16}, "b")).tokens.unprotect(token, None)
    with pytest.raises(InvalidArgumentError):
        KeyRing({"a": b"short"}, "a")


def test_limits(spark, ns):
    small = Namespace(spark, "demo", options=QueryOptions(result_items=10))
    small.bind(ns.schema("place"), ns.data("place"))
    with pytest.raises(QueryLimitError):
        small.query("place").where(P.rank >= 0).ids()
    for size in (0, 1025):
        with pytest.raises(ArgumentRangeError):
            ns.query("place").where(P.rank >= 0).page(size)
    with pytest.raises(ArgumentRangeError):
        QueryOptions(page_size=5000)
    with pytest.raises(ArgumentRangeError):
        ns.query("place").value_counts("city", 1025)


def test_what_queries_do_not_do(ns):
    q = ns.query("place")
    with pytest.raises(UnsupportedQueryError):
        q.ids()
    for name in ("select", "order_by", "skip", "take", "group_by", "join"):
        with pytest.raises(UnsupportedQueryError):
            getattr(q, name)("x")
    with pytest.raises(UnsupportedQueryError):
        list(q)
    with pytest.raises(SchemaError):
        ns.query("absent")
    with pytest.raises(InvalidArgumentError):
        q.min_max("tags")
    with pytest.raises(InvalidArgumentError):
        q.min_max("key")


def test_facets(ns):
    q = ns.query("place")
    assert q.min_max("rank") == (0, 6)
    assert q.where(P.rank > 100).min_max("rank") is None
    counts = q.value_counts("city")
    assert counts.counts == [("London", 20), ("Oslo", 20)] and counts.is_exact and counts.maximum_omitted == 0
    top = q.where(P.open == True).value_counts("rank", 2)  # noqa: E712
    want = sorted(((sum(r[2] == v and r[3] for r in ROWS), -v) for v in range(7)), reverse=True)
    assert top.counts == [(-v, n) for n, v in want[:2]] and top.maximum_omitted == want[2][0]
    values, page = [], q.distinct_page("rank", 3)
    while True:
        values += page.items
        if not page.token:
            break
        page = q.distinct_page("rank", 3, page.token)
    assert values == list(range(7))


def test_hidden_winner_and_certificate(spark):
    """A value that no owner nominates can still be the most frequent: the bound must say so."""
    rows = [(i, v, o) for i, (v, o) in enumerate([("a", 0), ("b", 1)] + [("z", 0)] * 5 + [("z", 1)] * 5)]
    data = spark.createDataFrame(rows, "id long, v string, owner int")
    ns = Namespace(spark, "cert")
    ns.bind(StateSchema.of("s", "id", data, v="hash"), data)
    assert ns.query("s").value_counts("v", 1).counts == [("z", 10)]
    rough = ns.query("s").approximate_counts("v", 1, F.col("owner"))
    assert rough.counts == [("a", 1)] and not rough.is_exact and rough.maximum_omitted == 10
    wide = ns.query("s").approximate_counts("v", 6, F.col("owner"))
    assert wide.counts == [("z", 10), ("a", 1), ("b", 1)] and wide.is_exact and wide.maximum_omitted == 0


def test_strict_cutoff(spark):
    """A last count equal to the bound does not prove exactness."""
    rows = [(i, v, 0) for i, v in enumerate(["a", "a", "b", "b"])]
    data = spark.createDataFrame(rows, "id long, v string, owner int")
    ns = Namespace(spark, "cert")
    ns.bind(StateSchema.of("s", "id", data, v="hash"), data)
    found = ns.query("s").approximate_counts("v", 1, F.col("owner"))
    assert found.counts == [("a", 2)] and not found.is_exact and found.maximum_omitted == 2


def test_text_facets_are_whole_or_nothing(spark):
    data = spark.createDataFrame([(1, "x" * 20_000), (2, "y")], "id long, v string")
    ns = Namespace(spark, "long")
    ns.bind(StateSchema.of("s", "id", data, v="hash"), data)
    with pytest.raises(Exception, match="too long"):
        ns.query("s").value_counts("v")


def test_hydration(spark, ns):
    ids = ns.query("place").where(P.city == "Oslo").ids_df()
    later = ns.data("place").where("rank <> 0").withColumn("city", F.when(F.col("rank") == 1, "Rome").otherwise(F.col("city")))
    left = {r["key"]: r for r in hydrate.left(ids, later, ["key"]).collect()}
    assert len(left) == 20 and all(left[r[0]]["found"] == (r[2] != 0) for r in ROWS if r[1] == "Oslo")
    again = hydrate.recheck(ids, later, ["key"], ns.query("place").where(P.city == "Oslo").plan)
    assert sorted(r["key"] for r in again.collect()) == brute(lambda r: r[1] == "Oslo" and r[2] > 1)


def test_plans_reach_the_files(spark, tmp_path, ns):
    ns.data("place").write.parquet(str(tmp_path / "p"))
    files = Namespace(spark, "files")
    files.read_state(ns.schema("place"), str(tmp_path / "p"))
    q = files.query("place").where((P.rank > 2.5) & (P.city == "Oslo"))
    plan = q.ids_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rank,3)" in plan and "EqualTo(city,Oslo)" in plan and "cast(rank" not in plan
    assert "tags" not in plan.split("ReadSchema")[1]
    assert q.ids() == brute(lambda r: r[1] == "Oslo" and r[2] > 2)


def test_providers_and_metrics(ns):
    q = ns.query("place").where(P.rank >= 0)
    assert isinstance(q, IdentifierProvider) and isinstance(q, PageProvider) and isinstance(q, FacetProvider)
    before = ns.metrics.operations["min_max", "ok"]
    q.min_max("rank")
    assert ns.metrics.operations["min_max", "ok"] == before + 1
    df, seen = ns.metrics.observed(ns.data("place"), "scan")
    df.collect()
    assert ns.metrics.record("scan", seen) == 60


def test_tokens_leave_no_key_in_a_plan_and_run_no_job(spark):
    ring = KeyRing({"k": bytes(range(32))}, "k")
    codec, binding = TokenCodec(spark, ring), Binding("p", "ids", "q", "o", 1, "y")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    token = codec.protect(binding, [1, "x"])
    assert codec.unprotect(token, binding) == [1, "x"] and token != codec.protect(binding, [1, "x"])
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    for wrong in (token[:-6], token[:4] + ("A" if token[4] != "A" else "B") + token[5:], "k.AAAA"):
        with pytest.raises(InvalidContinuationError):
            codec.unprotect(wrong, binding)
    with pytest.raises(InvalidContinuationError):
        TokenCodec(spark, KeyRing({"k": bytes(32)}, "k")).unprotect(token, binding)


def test_a_value_that_became_nan_matches_no_more(spark):
    data = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, v double")
    ns = Namespace(spark, "n")
    ns.bind(StateSchema.of("s", "id", data, v="range"), data)
    query = ns.query("s").where(P.v > 1.0)
    later = spark.createDataFrame([(1, float("nan")), (2, 6.0)], "id long, v double")
    assert [r.id for r in hydrate.recheck(query.ids_df(), later, ["id"], query.plan).collect()] == [2]


def test_ceilings_of_facets_and_walks(spark):
    data = spark.createDataFrame([(i, i % 7) for i in range(40)], "id long, v long")
    ns = Namespace(spark, "n", options=QueryOptions(facet_items=6, rounds=3, page_size=8))
    ns.bind(StateSchema.of("s", "id", data, v="range"), data)
    with pytest.raises(QueryLimitError):
        ns.query("s").value_counts("v", 2)
    assert ns.query("s").where(P.v < 6).value_counts("v", 2).counts == [(0, 6), (1, 6)]
    walk = ns.query("s").where(P.v >= 0).pages()
    assert [len(next(walk).items) for _ in range(3)] == [8, 8, 8]
    with pytest.raises(QueryLimitError):
        next(walk)


def test_a_facet_reads_one_version(spark, tmp_path):
    kind = "key string, city string"
    ns = Namespace(spark, "n", f"file://{tmp_path}")
    ns.register(StateSchema.of("s", "key", spark.createDataFrame([], kind), city="hash"))
    ns.writer("s").upsert(spark.createDataFrame([("a", "Oslo"), ("b", "Rome")], kind))
    reads, real = [], Table.manifest
    try:
        Table.manifest = lambda self: reads.append(1) or real(self)
        answer = ns.query("s").approximate_counts_df("city", 2, F.lit(0))
        data_reads = len(reads)
        ns.writer("s").upsert(spark.createDataFrame([("c", "Oslo"), ("d", "Wien")], kind))
    finally:
        Table.manifest = real
    assert data_reads <= 3  # whether the schema is active, twice, and the one version that is read
    assert sorted((r.value, r.n) for r in answer.collect()) == [("Oslo", 1), ("Rome", 1)]


def test_a_walk_has_no_ceiling(spark, tmp_path):
    """More pages than rounds, over keys of several columns with repeats and a null; each token leads to its page."""
    rows = [(i // 9, None if i == 4 else f"k{i % 9}") for i in range(100)]
    data = spark.createDataFrame(rows * 2, "a long, b string").withColumn("v", F.lit(1)).repartition(7)
    ns = Namespace(spark, "n", options=QueryOptions(rounds=3))
    ns.bind(StateSchema.of("s", ("a", "b"), data, v="range"), data)
    query = ns.query("s").where(P.v >= 1)
    with pytest.raises(QueryLimitError):
        list(query.pages(8))
    found = sorted((r.page, r.a, r.b or "", r.token) for r in query.walk_df(f"file://{tmp_path}/w", 8).collect())
    assert [(a, b) for _, a, b, _ in found] == sorted((a, b or "") for a, b in rows)
    assert [page for page, *_ in found] == [i // 8 for i in range(100)]
    tokens = {page: token for page, *_, token in found}
    assert tokens[0] is None and len(set(tokens.values())) == 13
    for page in (1, 6, 12):
        assert query.page(8, tokens[page]).items == [(a, b) for p, a, b, _ in found if p == page]
    assert query.page(8, tokens[12]).token is None
    # Whole pages leave no token to an empty one; nothing found is no page.
    exact = ns.query("s").where(P.v >= 1).walk_df(f"file://{tmp_path}/x", 10)
    assert exact.agg(F.count_distinct("page"), F.count_distinct("token")).first()[:] == (10, 9)
    assert ns.query("s").where(P.v > 1).walk_df(f"file://{tmp_path}/y", 10).count() == 0


@pytest.mark.parametrize("kind", ["string", "binary", "date", "timestamp", "decimal(20,3)", "double", "int"])
def test_a_walk_takes_keys_of_any_type(spark, tmp_path, kind):
    number = F.col("id").cast("int")
    key = {"string": F.concat(F.lit("\u00e9"), "id"), "binary": F.encode(F.col("id").cast("string"), "utf-8"), "date": F.date_add(F.lit("2024-01-01").cast("date"), number)}.get(kind, F.col("id").cast(kind))
    data = spark.range(50).select(key.alias("page"), F.lit(1).alias("v"))  # a key may have the name of a column of the walk
    ns = Namespace(spark, "n")
    ns.bind(StateSchema.of("s", "page", data, v="range"), data)
    walked = ns.query("s").where(P.v == 1).walk_df(f"file://{tmp_path}/w", 7).toDF("k", "page", "token")
    assert [r[0] for r in walked.orderBy("page", "k").collect()] == ns.query("s").where(P.v == 1).ids()
    assert walked.agg(F.count_distinct("page")).first()[0] == 8


def test_walked_pages_goes_beyond_the_rounds(spark, tmp_path):
    most = QueryOptions().rounds * 1024
    spark.range(most + 5000).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "'1-URGENT' AS o_orderpriority", "id AS o_custkey", "400000D + id AS o_totalprice", "timestamp'2024-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = workload.walked_pages(spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("o_orderkey"), F.min("o_orderkey"), F.max("o_orderkey")).first()
    assert got[:] == (most + 4999, most + 4999, 1, most + 4999)
