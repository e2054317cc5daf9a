import datetime as dt
import random

from circadia.llm import urls
from circadia.llm.queries import ORACLES, QUERIES

DAY = dt.date(2024, 1, 1)
ENTRY = "list string, allows boolean, pattern string, day date, action string"


def brute(captures, entries):
    """The deciding entry of each capture, straight from the dated entries."""
    out = []
    for key, url, day in captures:
        best = None
        rest = url.split("://", 1)[1] if url and "://" in url else None
        if rest and day:
            host, _, path = rest.partition("/")
            host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
            place = (host + "/" + path.split("?")[0].split("#")[0]).rstrip("/")
            for kind in {e[:3] for e in entries if e[2] and e[3] and e[4] in ("add", "remove")}:
                name, allows, pattern = kind
                if not (host == pattern or host.endswith("." + pattern) or place == pattern or place.startswith(pattern + "/")):
                    continue
                days = sorted({e[3] for e in entries if e[:3] == kind and e[3] and e[3] <= day})
                since = None
                for d in days:
                    if any(e[4] == "remove" for e in entries if e[:3] == kind and e[3] == d):
                        since = None
                    else:
                        since = since or d
                if since:
                    found = (len(pattern), allows, name, pattern, since)
                    best = max(best or found, found)
        out.append((key, url, day, best and ("allow" if best[1] else "block"), best and best[2], best and best[3], best and best[4]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "other.org", "hot.net"]
    entries = []
    for _ in range(120):
        pattern = rng.choice(hosts) + rng.choice(["", "", "/x", "/x/y"])
        name = rng.choice(["spam", "ads", "good"])
        entries.append((name, name == "good", pattern, DAY + dt.timedelta(rng.randint(0, 150)), rng.choice(["add", "add", "remove"])))
    entries += [("spam", False, None, DAY, "add"), ("spam", False, "hot.net", None, "add"), ("spam", False, "hot.net", DAY, "other"), (None, False, "hot.net", DAY, "add")]
    captures = []
    for i in range(400):
        host = rng.choice([*hosts, "hot.net", "hot.net", "hot.net"])
        url = f"http://{rng.choice(['', 'u@'])}{host.upper() if i % 5 == 0 else host}{rng.choice(['', ':80'])}/{rng.choice(['', 'x', 'x/', 'x/y/z', 'xy'])}{rng.choice(['', '?q=/x', '#x'])}"
        captures.append((i, url, DAY + dt.timedelta(rng.randint(-5, 200))))
    captures += [(1000, None, DAY), (1001, "no url", DAY), (1002, "http://hot.net/x", None), (None, "http://hot.net/x", DAY + dt.timedelta(80)), (1, "http:///x", DAY)]
    captures += captures[:20]
    known = [e for e in entries if e[0] is not None]
    table = spark.createDataFrame([(*c, "x") for c in captures], "page_id long, url string, day date, list string").repartition(3)
    spans = urls.intervals(spark.createDataFrame(entries, ENTRY))
    rows = [tuple(r) for r in urls.as_of(table, spans).collect()]
    assert sorted(rows, key=repr) == sorted(brute(captures, known), key=repr)
    empty = urls.intervals(spark.createDataFrame([], ENTRY))
    assert {r.verdict for r in urls.as_of(table, empty).collect()} == {None}
    assert urls.as_of(table.where("false"), spans).collect() == []


def test_far_days_and_open_entries(spark, tmp_path):
    """500 entries that stand, and captures in year 9999 and year 1: nothing is laid out over time."""
    entries = [("spam", False, f"h{i}.net", DAY + dt.timedelta(i % 9), "add") for i in range(500)]
    captures = [(1, "http://h1.net/x", dt.date(9999, 12, 31)), (2, "http://h2.net/", DAY + dt.timedelta(3)), (3, "http://h3.net/", dt.date(1, 1, 1)), (4, "http://h4.net/", None)]
    spark.createDataFrame(captures, "page_id long, url string, day date").write.parquet(str(tmp_path / "captures"))
    spark.createDataFrame(entries, ENTRY).write.parquet(str(tmp_path / "entries"))
    found = urls.as_of(spark.read.parquet(str(tmp_path / "captures")), urls.intervals(spark.read.parquet(str(tmp_path / "entries"))))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(captures, entries), key=repr)
    assert {r.page_id for r in found.where("verdict = 'block'").collect()} == {1, 2}


def test_only_null_days(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.net/", None), (2, None, None)], "page_id long, url string, day date").write.parquet(str(tmp_path / "c"))
    spans = urls.intervals(spark.createDataFrame([("spam", False, "a.net", DAY, "add")], ENTRY))
    found = urls.as_of(spark.read.parquet(str(tmp_path / "c")), spans).collect()
    assert sorted((r.page_id, r.verdict) for r in found) == [(1, None), (2, None)]


def test_overlapping_spans(spark):
    """Given by hand, or of a list that says allows = false once and null once."""
    spans = [("l", None, "a.net", DAY, None), ("l", False, "a.net", DAY + dt.timedelta(4), DAY + dt.timedelta(5))]
    table = spark.createDataFrame(spans, "list string, allows boolean, pattern string, since date, until date")
    captures = spark.createDataFrame([(d, "http://a.net/", DAY + dt.timedelta(d)) for d in (-1, 0, 4, 9)], "page_id long, url string, day date")
    assert {r.page_id: r.verdict for r in urls.as_of(captures, table).collect()} == {-1: None, 0: "block", 4: "block", 9: "block"}


def test_registered_with_sql():
    assert "op6_url_lists_as_of" in QUERIES and "op6_url_lists_as_of" in ORACLES


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_url_lists_as_of"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
