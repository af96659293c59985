"""Search, lookup, context, aggregation and case operators on small tables."""

import collections
import itertools
import json
import random
from datetime import datetime as ts, timedelta

import pytest
from pyspark.sql import Observation, functions as F

from logloom.operators import cases as C
from logloom.operators import filters as flt
from logloom.operators.aggregates import count_by_bucket, counted, estimate_scan, list_groups, list_streams, stats
from logloom.operators.around import around, around_many, around_segments
from logloom.operators.context import with_context, with_time_context
from logloom.operators import discover
from logloom.operators.discover import discover_fields, discover_json_paths
from logloom.operators.lookup import get_records, missing_ptrs, ptr_candidates, resolve_ptrs
from logloom.operators.metrics import metric_catalog, metric_names, metric_stats, with_spike_level
from logloom.operators.projections import dimension_text, extra_fields, order_stats_columns, rfc3339_text, to_export
from logloom.operators.ranking import dedup_events, keep_latest, newest, result_index
from logloom.operators.similar import _pairs, similar_names
from logloom.operators.sinks import CASE_FOLDERS, read_case, read_csv_export, write_entries, write_evidence, write_report
from logloom.plans.ordered import number_rows
from logloom.schemas import CASES, ENTRY, EVIDENCE, METRICS, TIMELINE

T0 = ts(2025, 1, 15, 10, 0)


@pytest.fixture
def entries(spark):
    def make(*rows):
        """(seconds after T0 or None, message, stream, fields)"""
        full = []
        for i, row in enumerate(rows, 1):
            at, message, stream, fields = (*row, *[None] * 4)[:4]
            when = None if at is None else T0 + timedelta(seconds=at)
            full.append((when, message, stream or "s", f"/{stream or 's'}", i, f"file:///{stream or 's'}#{i}", fields))
        return spark.createDataFrame(full, ENTRY)

    return make


def messages(df):
    return [r["message"] for r in df.collect()]


def test_time_range(entries):
    df = entries((0, "a"), (60, "b"), (120, "c"), (None, "n"))
    at = lambda s: (T0 + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
    assert messages(flt.time_range(df, at(60), at(120))) == ["b", "c", "n"]
    assert messages(flt.time_range(df, at(60), keep_null=False)) == ["b", "c"]
    assert messages(flt.time_range(df, None, at(0))) == ["a", "n"]
    assert messages(flt.time_range(df)) == ["a", "b", "c", "n"]


def test_terms(entries):
    assert flt.or_terms("error|exception") == ["error", "exception"]
    assert flt.or_terms(" error |  two \t words ") == ["error", "two words"]
    assert flt.or_terms("error||exception") == ["error", "exception"]
    assert messages(flt.contains_any(entries((0, "an error"), (1, "Error"), (2, "fine")), "error|none")) == ["an error"]


def test_small_filters(spark, entries):
    names = spark.createDataFrame([("/app/a",), ("/app/ab",), ("/x",)], "name string")
    assert flt.name_prefix(names, "/app").count() == 2
    assert flt.by_name(names, "/app/a", required=True).count() == 1
    with pytest.raises(LookupError):
        flt.by_name(names, "/app", required=True)
    assert flt.dimension_arguments(["LoadBalancer=app/x=1"]) == {"LoadBalancer": "app/x=1"}
    with pytest.raises(ValueError):
        flt.dimension_arguments(["bad"])
    df = entries((0, "a", None, {"action": "BLOCK"}), (1, "b", None, {"action": "ALLOW"}), (2, "c", None, None))
    assert messages(flt.field_equals(df, "action", "BLOCK")) == ["a"]


def test_newest(entries):
    df = entries((0, "a"), (None, "n"), (120, "c"), (60, "b"))
    assert messages(newest(df)) == ["c", "b", "a", "n"]
    assert messages(newest(df, 2)) == ["c", "b"]


def test_around(entries):
    df = entries(*[(i * 60, str(i)) for i in range(20)])
    assert messages(around(df, "2025-01-15T10:10:00Z", "2m")) == ["12", "11", "10", "9", "8"]
    assert messages(around(df, "2025-01-15T10:10:00Z", "2m", "1", 2)) == ["12", "11"]


@pytest.fixture
def crowd(entries):
    """Many events of few streams, many at equal times, one stream far larger."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        rows.append((rng.randrange(0, 600) / 4, f"m{i}", "hot" if rng.random() < 0.7 else f"s{i % 3}"))
    return entries(*rows, (None, "untimed", "hot"))


@pytest.mark.parametrize("slice_rows", [5, 50, 2_000_000])
def test_time_context_against_brute_force(crowd, slice_rows):
    rows = crowd.collect()
    matches = crowd.filter(F.col("message").rlike("7$|untimed"))
    found = with_time_context(matches, crowd, 3, "20s", slice_rows=slice_rows).collect()
    assert len(found) == matches.count()
    for m in found:
        want = []
        if m["timestamp"] is not None:
            lo, hi = m["timestamp"] - timedelta(seconds=20), m["timestamp"] - timedelta(milliseconds=1)
            near = [r for r in rows if r["stream"] == m["stream"] and r["timestamp"] is not None and lo <= r["timestamp"] <= hi]
            want = [r["message"] for r in sorted(near, key=lambda r: (r["timestamp"], r["ptr"]))[-3:]]
        assert [e["message"] for e in m["context"]["before"]] == want
        assert m["context"]["after"] == []


@pytest.mark.parametrize("slice_rows, limit", [(5, 4), (2_000_000, 4), (60, 1000), (1, None)])
def test_around_many_against_brute_force(crowd, slice_rows, limit):
    rows = [r for r in crowd.collect() if r["timestamp"] is not None]
    anchors = crowd.filter(F.col("message").endswith("9")).select(F.col("line_no").alias("anchor_id"), F.col("timestamp").alias("anchor_ts"))
    got = {}
    for r in around_many(crowd, anchors, "5s", limit=limit, slice_rows=slice_rows).collect():
        got.setdefault(r["anchor_id"], set()).add(r["message"])
    for a in anchors.collect():
        near = [r for r in rows if abs(r["timestamp"] - a["anchor_ts"]) <= timedelta(seconds=5)]
        near.sort(key=lambda r: (r["timestamp"], r["ptr"]), reverse=True)
        assert got[a["anchor_id"]] == {r["message"] for r in near[:limit]}


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_segments_of_overlapping_windows(entries, spark, chunk):
    random.seed(chunk)
    # A third of all entries at one moment; anchors that repeat, touch and lie apart.
    at = [500] * 100 + [random.randrange(2000) for _ in range(200)]
    logs = entries(*[(s, f"m{i}") for i, s in enumerate(at)], (None, "untimed"))
    moments = [500, 500, 510, 531, 540, 900, 920, 941, *random.sample(range(1000, 2000), 12)]
    anchors = spark.createDataFrame([(i, T0 + timedelta(seconds=s)) for i, s in enumerate(moments)] + [(99, None)], "anchor_id bigint, anchor_ts timestamp")
    tagged, members = around_segments(logs, anchors, "10s", chunk_rows=chunk)
    ends, starts = {}, {}
    for s in sorted(set(moments)):
        name = ends.get(max((e for e in ends if e >= s - 20), default=None))
        ends[s], starts[s] = (name, name) if name is not None else (s, s)
    seconds = lambda micros: round(micros / 1e6 - (T0 - ts(1970, 1, 1)).total_seconds())
    assert sorted((r["anchor_id"], seconds(r["segment"])) for r in members.collect()) == [(i, starts[s]) for i, s in enumerate(moments)]
    for r in members.collect():
        own = [s for s in moments if starts[s] == seconds(r["segment"])]
        assert (r["low"], r["high"]) == (T0 + timedelta(seconds=min(own) - 10), T0 + timedelta(seconds=max(own) + 10))
    near = [(f"m{i}", min(starts[c] for c in moments if abs(c - s) <= 10)) for i, s in enumerate(at) if any(abs(c - s) <= 10 for c in moments)]
    assert tagged.columns == [*logs.columns, "segment"]
    assert sorted((r["message"], seconds(r["segment"])) for r in tagged.collect()) == sorted(near)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_endings_against_brute_force(spark, chunk):
    random.seed(chunk)
    ptrs = ["".join(random.choices("abé😀\uffff", k=random.randint(0, 9))) for _ in range(120)] + ["x" * 60, "ab", "ab"]
    refs = list({"@" + "".join(random.choices("abé😀\uffff", k=random.randint(0, 4))) for _ in range(80)} | {"@" + p[-3:] for p in ptrs} | {"@" + "x" * 49, "zz", "é"})
    table = spark.createDataFrame([(i, p) for i, p in enumerate(ptrs, 1)], "idx int, ptr string")
    got = {r["ref"]: (r["ptr"], r["status"], r["matches"]) for r in resolve_ptrs(spark.createDataFrame([(r,) for r in refs], "ref string"), table, chunk_rows=chunk).collect()}
    assert set(got) == set(refs)
    for ref in refs:
        term = ref.removeprefix("@")
        hits = {p for p in ptrs if term and p.endswith(term)}
        status = "missing" if not hits else "resolved" if len(hits) == 1 else "ambiguous"
        assert got[ref] == (min(hits) if len(hits) == 1 else None, status, len(hits)), ref


def test_context_of_whole_entries(spark, lines):
    text = lines("a\nhead\n\tx\n\ty\nb\nc")
    match = spark.createDataFrame([("/var/log/app.log", 2, "head\n\tx\n\ty")], "source string, line_no bigint, message string")
    after = lambda **k: [e["message"] for e in with_context(match, text, 1, 2, 1, **k).first()["context"]["after"]]
    assert after() == ["\tx", "\ty"]
    assert after(whole_entries=True) == ["b", "c"]


def test_records_by_pointer(entries, spark):
    df = entries((0, "a"), (1, "b"))
    wanted = ["file:///s#2", "file:///s#9", "file:///s#2"]
    table = spark.createDataFrame([(w,) for w in wanted], "ptr string")
    for ptrs in (wanted, table):
        assert messages(get_records(df, ptrs)) == ["b"]
        assert [r["ptr"] for r in missing_ptrs(df, ptrs).collect()] == ["file:///s#9"]


def resolved(spark, index, refs, legacy=False):
    table = spark.createDataFrame([(i, p) for i, p in enumerate(index, 1)], "idx int, ptr string")
    asked = spark.createDataFrame([(r,) for r in refs], "ref string")
    return {r["ref"]: (r["ptr"], r["status"], r["matches"]) for r in resolve_ptrs(asked, table, legacy).collect()}


def test_resolve(spark):
    index = ["abc123def456", "xyz789mnopqr", "ghi456jkl789"]
    long = "x" * 51
    got = resolved(spark, index, ["456", "2", "@jkl789", "nope", long, "9", "0"])
    assert got == {
        "456": ("abc123def456", "resolved", 1), "2": ("xyz789mnopqr", "index", 1), "@jkl789": ("ghi456jkl789", "resolved", 1),
        "nope": (None, "missing", 0), long: (long, "full", 1), "9": ("ghi456jkl789", "resolved", 1), "0": (None, "missing", 0),
    }
    assert resolved(spark, ["aaa123", "bbb123", "ccc123"], ["@123"]) == {"@123": (None, "ambiguous", 3)}
    assert resolved(spark, ["abc123"], ["xyz"]) == {"xyz": (None, "missing", 0)}
    assert resolved(spark, index, ["789mn", "j"], True) == {"789mn": ("xyz789mnopqr", "resolved", 1), "j": ("ghi456jkl789", "resolved", 1)}
    table = spark.createDataFrame([(1, "a1"), (2, "b1"), (3, "c2")], "idx int, ptr string")
    assert ptr_candidates("@1", table).count() == 2


def test_result_index(entries):
    df = entries((0, "a"), (60, "b"), (30, "c"))
    rows = result_index(df, 2, {"type": "local", "uri": "/x"}).orderBy("idx").collect()
    assert [(r["idx"], r["ptr"], r["source_uri"], r["source_type"]) for r in rows] == [(1, "file:///s#2", "/x", "local"), (2, "file:///s#3", "/x", "local")]
    with pytest.raises(ValueError):
        result_index(df, 0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_names_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abC") for _ in range(rng.randrange(0, 8))) for _ in range(60)] + ["prod-api", "prod-app", "Prod-Api"]
    targets = ["prod-apl", "", "abc", "cccccccc", "prdapi", "zzzzzzzzzzz", "abab"]
    got = {}
    names = spark.createDataFrame([(w,) for w in words], "name string")
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    for r in similar_names(names, asked).orderBy("target", "rank").collect():
        got.setdefault(r["target"], []).append((r["distance"], r["name"]))
    for t in targets:
        near = sorted((distance(t.lower(), w.lower()), w) for w in set(words))
        assert got.get(t, []) == [x for x in near if x[0] <= 3][:3], t


@pytest.mark.parametrize("distance", range(4))
def test_spellings_are_never_broadcast(spark, tmp_path, distance):
    # A small file, whose spellings are hundreds of times as many.
    spark.createDataFrame([(f"Customer#{i:09}", f"Custmer#{i:09}") for i in range(50)], "name string, target string").write.parquet(f"{tmp_path}/names")
    rows = spark.read.parquet(f"{tmp_path}/names").withColumns({"low": F.lower("name"), "target_low": F.lower("target")})
    names, words = rows.select("name", "low"), rows.select("target", F.col("target_low").alias("low"))
    pairs = _pairs(names, words, distance)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_dedup(entries):
    df = entries((0, "a"), (0, "a"), (0.001, "a"), (0, "b"))
    assert dedup_events(df).count() == 3
    assert sorted(r["line_no"] for r in dedup_events(df, first="line_no").collect()) == [1, 3, 4]


def test_keep_latest(entries):
    df = entries(*[(i, f"m{i}", "ab"[i % 2]) for i in range(10)])
    assert sorted(messages(keep_latest(df, "stream", "timestamp", 2))) == ["m6", "m7", "m8", "m9"]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_number_rows(spark, chunk):
    seqs = {"a": [2, 3, 50, 51, 52, 400], "b": [1], "c": [999, 1000]}
    rows = [(k, s) for k, values in seqs.items() for s in values]
    got = number_rows(spark.createDataFrame(rows, "k string, seq bigint"), ["k"], "seq", chunk_rows=chunk)
    want = sorted((k, s, i) for k, values in seqs.items() for i, s in enumerate(values, 1))
    assert sorted((r["k"], r["seq"], r["n"]) for r in got.collect()) == want


def test_buckets_and_stats(entries):
    df = entries((0, "error"), (299, "Error"), (300, "error"), (None, "error"), (10, "ok"))
    rows = count_by_bucket(df, pattern="error").collect()
    assert [(r["time_bucket"], r["count"]) for r in rows] == [(T0 + timedelta(minutes=5), 1), (T0, 2)]
    assert count_by_bucket(df, limit=1).count() == 1
    tagged = entries(*[(0, "m", None, {"ip": ip}) for ip in "aabbbc"])
    out = stats(tagged, {"total": F.count(F.lit(1))}, ["ip"], F.col("total") > 1, "total", 20).collect()
    assert [(r["ip"], r["total"]) for r in out] == [("b", 3), ("a", 2)]
    assert order_stats_columns(out_columns(tagged)).columns == ["time_bucket", "count", "sum", "avg", "min", "max", "a", "z"]


def out_columns(df):
    return df.select(*[F.lit(1).alias(c) for c in ("z", "max", "a", "min", "avg", "@ptr", "sum", "count", "time_bucket")])


def test_count_beside_the_result(entries):
    seen = Observation("o")
    counted(entries((0, "a"), (1, "b")), seen).collect()
    assert seen.get["results"] == 2


def test_metrics(spark):
    points = [("ns", "m", {"a": "1"}, T0 + timedelta(minutes=i), float(i), "Count") for i in range(10)] + [("ns", "m", {"a": "2"}, T0, 100.0, "Count"), ("ns", "k", {}, T0, 1.0, None)]
    df = spark.createDataFrame(points, METRICS)
    got = {s: [r["value"] for r in metric_stats(df, "ns", "m", ["a=1"], s).collect()] for s in ("Sum", "avg", "MIN", "max", "count")}
    assert got == {"Sum": [10.0, 35.0], "avg": [2.0, 7.0], "MIN": [0.0, 5.0], "max": [4.0, 9.0], "count": [5.0, 5.0]}
    ranged = metric_stats(df, "ns", "m", {"a": "1"}, "Sum", "1 minute", "3m", "2025-01-15T10:05:00Z").collect()
    assert [r["value"] for r in ranged] == [2.0, 3.0, 4.0]
    assert metric_catalog(df).count() == 3 and metric_catalog(df, "ns", "k").count() == 1
    assert metric_names(df).first()["metric_names"] == ["k", "m"]
    assert spark.range(1).select(dimension_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).first()[0] == "a=1;b=2"


def test_spike_level(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 47.0, 30.0, 0.0)] + [("z", 0.0)], "k string, value double")
    got = {(r["k"], r["value"]): (r["level"], r["bar"]) for r in with_spike_level(df, ("k",)).collect()}
    assert got == {("a", 5.0): ("low", 4), ("a", 47.0): ("high", 40), ("a", 30.0): ("medium", 25), ("a", 0.0): ("low", 0), ("z", 0.0): ("low", 0)}
    assert with_spike_level(df.filter("k = 'a'")).filter("level = 'high'").count() == 1


def test_listings(spark, entries):
    df = entries((0, "abc", "x"), (60, "ä", "x"), (30, "z", "y"), (None, "q", "w"))
    got = [(r["name"], r["size"], r["last_time"]) for r in list_streams(df).collect()]
    assert got == [("x", 5, T0 + timedelta(seconds=60)), ("y", 1, T0 + timedelta(seconds=30)), ("w", 1, None)]
    assert [r["name"] for r in list_streams(df, order="name").collect()] == ["y", "x", "w"]
    kept = spark.createDataFrame([("/x", 30)], "name string, retention_days int")
    got = [(r["name"], r["stored_bytes"], r["retention"]) for r in list_groups(df, kept).collect()]
    assert got == [("/w", 1, "Never expire"), ("/x", 5, "30 days"), ("/y", 1, "Never expire")]


def test_scan_estimate(spark):
    groups = spark.createDataFrame([("a", 1 << 31, T0), ("b", 0, T0), ("c", 100, None), ("d", 240, T0 + timedelta(days=9))], "name string, stored_bytes bigint, creation_time timestamp")
    now = T0 + timedelta(days=4)
    rows = {r["name"]: r for r in estimate_scan(groups, now - timedelta(days=1), now, now).collect()}
    assert rows["a"]["estimated_bytes"] == 1 << 29 and rows["a"]["estimated_size"] == "512.0 MB"
    assert rows["a"]["estimated_cost"] == pytest.approx(0.0025)
    assert rows["b"]["estimated_bytes"] is None and rows["c"]["estimated_bytes"] is None
    assert rows["d"]["estimated_bytes"] == 240  # a day of a one-day age


def test_discover(entries):
    df = entries((0, "m", None, {"@x": "", "a": "old"}), (60, "m", None, {"@x": "v" * 70, "b": ""}), (30, "m", None, {"a": "new\nline"}))
    got = {r["name"]: (r["kind"], r["count"], r["sample"]) for r in discover_fields(df).collect()}
    assert got == {"@x": ("system", 2, "v" * 60 + "..."), "a": ("custom", 2, "new line"), "b": ("custom", 1, "")}
    assert {r["name"] for r in discover_fields(df, 1).collect()} == {"@x", "b"}


PATHS = [
    ('{"name":"test","count":42}', {"name": "test", "count": "42"}), ('{"user":{"name":"John"}}', {"user.name": "John"}), ('{"active":true}', {"active": "true"}),
    ('{"value":null}', {"value": "null"}), ('{"a":[{"k":1},{"z":2}]}', {"a[].k": "1"}), ('{"a":[]}', {"a[]": "(empty array)"}), ('{"a":[1,2]}', {"a[]": "1"}),
    ('{"a":{},"b":1.5}', {"b": "1.5"}), (' {"a":{"b":{"c":{"d":"x{"}}}}', {"a.b.c.d": "x{"}), ("not json", {}), ('{"broken"', {}), ('{"a":[[1],2]}', {"a[]": "[1]"}),
    ('{"q":"\\"{{{","r":{"s":[{"t":[{"u":1e3}]}]}}', {"q": '"{{{', "r.s[].t[].u": "1000"}),
]


def test_json_paths(entries):
    for text, want in PATHS:
        assert {r["name"]: r["sample"] for r in discover_json_paths(entries((0, text))).collect()} == want, text
    both = discover_json_paths(entries(*[(i, t) for i, (t, _) in enumerate(PATHS)]), None).collect()
    assert {r["name"] for r in both} == set(itertools.chain.from_iterable(w for _, w in PATHS))


MIXED = [
    '{"m":1,"s":{"q":[1,{"w":{"v":1}}]}}', '{"m":{"u":{"w":[]}},"s":null,"n":[[],{}]}', '{"m":[{"k":{"z":2}}],"s":{"q":[{"w":5}]},"n":[{"a":[{}]}]}', '{"m":{"u":7},"n":[null]}',
    '{"a b":{"c.d":1,"x`y":[2]},"q\'r":{"e":1},"\\"":{"\'\\"":3,"":4},"t":[],"t2":null}', '{"":{"":1},"t":[{"p":0.5}],"t2":{"o":[]}}',
]


def plain_paths(texts):
    """The paths of JSON records by recursion, with their numbers."""
    found = collections.Counter()

    def members(obj, name):
        for k, v in obj.items():
            path = f"{name}.{k}" if name else k
            if isinstance(v, list):
                path, v = path + "[]", v[0] if v else "(empty array)"
            if isinstance(v, dict):
                members(v, path)
            else:
                found[path] += 1

    for t in texts:
        members(json.loads(t), "")
    return found


@pytest.mark.parametrize("most", [300, 3])
def test_json_paths_of_mixed_kinds(entries, monkeypatch, most):
    """Looked up one by one, and, beyond PATHS, opened level by level."""
    monkeypatch.setattr(discover, "PATHS", most)
    df = entries(*[(i, t) for i, t in enumerate(MIXED)])
    assert {r["name"]: r["count"] for r in discover_json_paths(df, None).collect()} == plain_paths(MIXED)


def test_json_paths_are_counted_in_one_aggregate(entries):
    """No leaf becomes a row of its own that is sorted by its name."""
    texts = ['{"a":[[1]],"o":{"p":null,"q":"null"}}', '{"a":[[2],3],"o":null}', '{"a":[],"o":{"p":{"r":1}}}', '{"e":""}', '{"e":"x"}', '{"a":[[]]}']
    df = discover_json_paths(entries(*[(i, t) for i, t in enumerate(texts)]), None)
    assert "SortAggregate(key=[]," in df._jdf.queryExecution().sparkPlan().toString()
    rows = {r["name"]: (r["count"], r["sample"]) for r in df.collect()}
    assert {n: c for n, (c, _) in rows.items()} == plain_paths(texts)
    assert rows["a[]"] == (4, "[]") and rows["e"] == (2, "x") and rows["o"] == (1, "null") and rows["o.q"] == (1, "null")


def test_json_paths_of_no_records(entries):
    assert discover_json_paths(entries((0, "no json")), None).collect() == []
    assert discover_json_paths(entries((0, "{}")), None).collect() == []


@pytest.fixture
def case_tables(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    action = lambda case, seq, kind, **k: tuple({"case_id": case, "seq": seq, "ts": at(seq), "type": kind, "marked": False, **k}.get(f) for f in TIMELINE.fieldNames())
    timeline = [action("c1", 1, "query", filter="x"), action("c1", 2, "note", content="n"), action("c1", 3, "query", marked=True), action("c1", 4, "query"), action("c1", 90, "evidence", content="e"), action("c2", 1, "note", content="only")]
    item = lambda case, seq, ptr: tuple({"case_id": case, "seq": seq, "ptr": ptr, "message": "m", "collected_at": at(seq), "raw_fields": {"k": "v", "@ptr": ptr, "z": ""}}.get(f) for f in EVIDENCE.fieldNames())
    evidence = [item("c1", 5, "file:///s#1"), item("c1", 9, "old")]
    cases = [("c1", "One", at(0), at(100), "active", "sum"), ("c2", "Two", at(0), at(200), "closed", ""), ("c3", "Three", at(0), at(50), "active", None)]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(timeline, TIMELINE), spark.createDataFrame(evidence, EVIDENCE)


def test_case_counts(case_tables):
    cases, timeline, evidence = case_tables
    row = C.case_stats(timeline, evidence).filter("case_id = 'c1'").first()
    assert (row["queries"], row["marked"], row["notes"], row["evidence"], row["time_span"]) == (3, 1, 1, 2, "1.5h")
    assert [(r["id"], r["queries"], r["evidence"]) for r in C.case_list(cases, timeline, evidence).collect()] == [("c2", 0, 0), ("c1", 3, 2), ("c3", 0, 0)]
    assert [r["id"] for r in C.case_list(cases, timeline, evidence, "closed").collect()] == ["c2"]


def test_timeline(case_tables):
    cases, timeline, _ = case_tables
    assert flt.timeline_filter(timeline, "query").count() == 3
    assert flt.timeline_filter(timeline, "query", True).count() == 1 and flt.timeline_filter(timeline, marked_only=True).count() == 1
    assert [r["seq"] for r in C.mark_last(timeline).filter("marked").orderBy("seq").collect()] == [3, 4]
    assert [r["id"] for r in C.cases_without_query(cases, timeline).orderBy("id").collect()] == ["c2", "c3"]
    rows = C.report_rows(timeline).filter("case_id = 'c1'").orderBy("number").collect()
    assert [(r["number"], r["seq"]) for r in rows] == [(1, 2), (2, 3), (3, 90)]
    assert C.report_rows(timeline, True).count() == 6


def test_collect_evidence(spark, case_tables, entries):
    _, timeline, evidence = case_tables
    logs = entries((0, "a", None, {"@log": "1:/g"}), (1, "b"))
    opaque = logs.filter("line_no = 1").withColumn("ptr", F.lit("opaque")).withColumn("source", F.lit(""))
    picks = [("c1", "file:///s#1", 1, "x"), ("c1", "file:///s#2", 2, "why"), ("c1", "file:///s#2", 3, "again"), ("c2", "file:///s#1", 1, None), ("c2", "gone", 2, None), ("c2", "opaque", 3, None)]
    table = spark.createDataFrame(picks, "case_id string, ptr string, seq bigint, annotation string")
    new, actions = C.collect_evidence(logs.unionByName(opaque), table, evidence, timeline, T0)
    got = sorted((r["case_id"], r["seq"], r["ptr"], r["message"], r["source_uri"], r["annotation"]) for r in new.na.fill("-", ["annotation"]).collect())
    assert got == [("c1", 10, "file:///s#2", "b", "file:///s", "why"), ("c2", 1, "file:///s#1", "a", "file:///s", "-"), ("c2", 2, "opaque", "a", "cloudwatch:///g", "-")]
    assert sorted((r["case_id"], r["seq"], r["type"], r["content"]) for r in actions.collect()) == [("c1", 91, "evidence", "b"), ("c2", 2, "evidence", "a"), ("c2", 3, "evidence", "a")]
    assert new.schema.fieldNames() == EVIDENCE.fieldNames() and actions.schema.fieldNames() == TIMELINE.fieldNames()


def test_annotate_and_audit(spark, case_tables):
    cases, timeline, evidence = case_tables
    updates = spark.createDataFrame([("c1", "old", "new text"), ("c1", "none", "x")], "case_id string, ptr string, annotation string")
    assert {r["ptr"]: r["annotation"] for r in C.annotate(evidence, updates).collect()} == {"file:///s#1": None, "old": "new text"}
    assert [r["ptr"] for r in C.unknown_evidence(evidence, updates).collect()] == ["none"]
    runs = spark.createDataFrame([("c1", 1, T0, "f", 3, None), ("c1", 2, T0, None, None, "a note"), ("c9", 1, T0, "g", 0, None)], "case_id string, seq bigint, ts timestamp, filter string, results int, content string")
    assert sorted((r["case_id"], r["seq"], r["type"]) for r in C.audit_rows(runs, timeline).collect()) == [("c1", 91, "query"), ("c1", 92, "note"), ("c9", 1, "query")]
    report = C.case_report(cases, timeline, evidence)
    assert {(r["case_id"], r["section"]): r["count"] for r in report.groupBy("case_id", "section").count().collect()} == {
        ("c1", "case"): 1, ("c2", "case"): 1, ("c3", "case"): 1, ("c1", "evidence"): 2, ("c1", "timeline"): 3, ("c2", "timeline"): 1}
    pairs = evidence.select(extra_fields(F.col("raw_fields")).alias("p")).first()["p"]
    assert [tuple(p) for p in pairs] == [("k", "v")]


def test_exports(spark, entries, tmp_path):
    df = entries((0.25, 'say "hi",\nthere', "x", {"@ptr": "p", "k": "v"}), (None, "n", "x", {"@message": "m"}))
    write_entries(df, str(tmp_path / "j"), "json")
    rows = [r.asDict(True) for r in spark.read.json(str(tmp_path / "j")).orderBy("message").collect()]
    assert rows[0]["timestamp"] is None and rows[0]["fields"] is None
    assert rows[1]["timestamp"] == "2025-01-15T10:00:00.25Z" and rows[1]["fields"] == {"k": "v"}
    write_entries(df, str(tmp_path / "c"), "csv")
    back = read_csv_export(spark, str(tmp_path / "c"), "timestamp string, stream string, source string, message string, ptr string")
    assert sorted(r["message"] for r in back.collect()) == ["n", 'say "hi",\nthere']
    with pytest.raises(ValueError):
        write_entries(df, str(tmp_path / "x"), "xml")
    with_context_column = df.withColumn("context", F.struct(F.array(F.struct("timestamp", "message", "stream")).alias("before"), F.array().cast("array<struct<timestamp:timestamp,message:string,stream:string>>").alias("after")))
    row = to_export(with_context_column).filter("message <> 'n'").first()
    assert row["context_before"][0]["timestamp"] == "2025-01-15T10:00:00.25Z" and row["context_after"] is None


def test_times_do_not_depend_on_the_session_zone(spark, lines):
    from logloom.parsers.registry import parse_lines

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = parse_lines(lines("2025-01-15 10:30:45 x")).select(F.unix_micros("timestamp").alias("u"), rfc3339_text(F.col("timestamp")).alias("t")).first()
        assert (row["u"], row["t"]) == (1736937045000000, "2025-01-15T10:30:45Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("write", [write_report, write_evidence])
def test_many_cases_make_few_folders(spark, tmp_path, write):
    rows = [(f"case-{i}", n, f"é {i}.{n}") for i in range(3 * CASE_FOLDERS) for n in range(3)] + [(None, 0, "no case")]
    schema = "case_id string, number bigint, body string"
    write(spark.createDataFrame(rows, schema), f"{tmp_path}/out")
    assert len([f for f in (tmp_path / "out").iterdir() if f.is_dir()]) <= CASE_FOLDERS
    back = spark.read.schema(schema).json(f"{tmp_path}/out")
    assert sorted(map(str, rows)) == sorted(str((r["case_id"], r["number"], r["body"])) for r in back.collect())
    one = read_case(spark, f"{tmp_path}/out", schema, "case-77")
    assert sorted(map(tuple, one.collect())) == [r for r in rows if r[0] == "case-77"]
    assert len({r[0] for r in one.select("_metadata.file_path").collect()}) == 1


def counted_reads(spark, df, column):
    """``df`` with an accumulator that counts how often its rows are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(look, "string").asNondeterministic()(F.col(column))), seen


def test_collected_evidence_is_joined_once(spark):
    logs = spark.createDataFrame([(ts(2024, 1, 1), f"m{i}", "s", "/a.log", i, f"file:///a.log#{i}", {}) for i in range(1, 21)], ENTRY)
    logs, seen = counted_reads(spark, logs, "message")
    picks = spark.createDataFrame([("c", f"file:///a.log#{i}", None, i) for i in range(1, 11)], "case_id string, ptr string, annotation string, seq bigint")
    new, actions = C.collect_evidence(logs, picks, spark.createDataFrame([], EVIDENCE), spark.createDataFrame([], TIMELINE), "2024-03-01T00:00:00Z")
    assert sorted(r["seq"] for r in new.collect()) == sorted(r["seq"] for r in actions.collect()) == list(range(1, 11))
    assert seen.value <= 20


def test_pointers_are_resolved_from_one_reading_of_the_endings(spark):
    index, seen = counted_reads(spark, spark.createDataFrame([(i, f"{i:03}end") for i in range(1, 41)], "idx int, ptr string"), "ptr")
    refs = spark.createDataFrame([("@012end",), ("@end",), ("@none",)], "ref string")
    got = {r["ref"]: (r["status"], r["ptr"], r["matches"]) for r in resolve_ptrs(refs, index, chunk_rows=5).collect()}
    assert got == {"@012end": ("resolved", "012end", 1), "@end": ("ambiguous", None, 40), "@none": ("missing", None, 0)}
    # Once for the endings, once for the places.
    assert seen.value <= 80
