import random
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

from quillmill.llm import urlfilter

START = datetime(2024, 1, 1, tzinfo=UTC)
EVENTS = "list_name string, verdict string, key string, action string, since timestamp"


def day(n):
    return START + timedelta(days=n)


def decide(url, when, events):
    """By looking at every entry for every capture."""
    if url is None or when is None or "://" not in url or not urlsplit(url).hostname:
        return "pass", None, None, 0
    parts = urlsplit(url)
    host = parts.hostname.rstrip(".")
    labels = host.split(".")
    path = [p for p in parts.path.split("/") if p]
    ranks = {"d:" + ".".join(labels[-k:]): k for k in range(1, len(labels) + 1)} | {f"p:{host}/" + "/".join(path[:k]): 100 + k for k in range(1, len(path) + 1)}
    hits = []
    for name, verdict, key in {e[:3] for e in events}:
        past = [e for e in events if e[:3] == (name, verdict, key) and e[4] is not None and e[4] <= when]
        if key in ranks and past and max(past, key=lambda e: (e[4], e[3]))[3] == "add":
            hits.append((-ranks[key], verdict, name, key))
    best = min(hits) if hits else None
    return (best[1], best[2], best[3], len(hits)) if best else ("pass", None, None, 0)


def test_matches_every_entry_against_every_capture(spark):
    rng = random.Random(12)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "example.org", "x.example.org"]
    events = []
    for _ in range(120):
        key = "d:" + rng.choice([*hosts, "com", "org"]) if rng.random() < 0.6 else f"p:{rng.choice(hosts)}/" + rng.choice(["en", "en/1", "de", "en/1/2/3"])
        events.append((rng.choice(["l1", "l2"]), rng.choice(["block", "allow"]), key, rng.choice(["add", "remove"]), day(rng.randrange(60))))
    events += [events[0], ("l1", "block", None, "add", day(1)), ("l1", "block", "d:com", "add", None)]
    rows = []
    for i in range(400):
        host = rng.choice(hosts)
        url = rng.choice(["http", "HTTPS"]) + "://" + rng.choice(["", "user:pw@"]) + rng.choice([host, host.upper(), host + "."]) + rng.choice(["", ":8080"]) + rng.choice(["", "/", "/en", "/en/1?x=/de", "/de#a/b", "/en//1/2/3", "?q"])
        rows.append((i, url, day(rng.randrange(-3, 65)) + timedelta(hours=rng.choice([0, 5]))))
    rows += [(900, None, day(1)), (901, "http://example.com", None), (902, "not a url", day(30)), (903, "http:///path", day(30)), (0, *rows[0][1:]), (None, *rows[1][1:]), (904, "", day(1))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, fetched timestamp, decision string, key string")
    expected = sorted((repr(i), *map(repr, decide(u, w, [e for e in events if e[2] and e[4]]))) for i, u, w in rows)
    for options in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "hot_rows": 40}):
        got = urlfilter.filter_captures(df, spark.createDataFrame(events, EVENTS), **options).collect()
        assert sorted((repr(r.page_id), repr(r.decision), repr(r.list_name), repr(r.matched_key), repr(r.n_matches)) for r in got) == expected, options
    assert {r.decision for r in got} == {"block", "allow", "pass"}


def test_intervals(spark):
    events = [("l", "block", "d:x", "add", day(1)), ("l", "block", "d:x", "add", day(3)), ("l", "block", "d:x", "remove", day(5)), ("l", "block", "d:x", "add", day(5)), ("l", "block", "d:x", "add", day(9))]
    got = urlfilter.validity_intervals(spark.createDataFrame(events, EVENTS)).orderBy("since").collect()
    naive = lambda d: d and d.replace(tzinfo=None)
    assert [(r.since, r.until) for r in got] == [(naive(day(1)), naive(day(3))), (naive(day(3)), naive(day(5))), (naive(day(9)), None)]


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b", day(1))], "page_id long, url string, fetched timestamp")
    nothing = spark.createDataFrame([], EVENTS)
    assert [r.decision for r in urlfilter.filter_captures(captures, nothing).collect()] == ["pass"]
    assert urlfilter.filter_captures(captures.limit(0), nothing).collect() == []


def test_deep_hosts_and_paths_match(spark):
    host = ".".join("abcdefgh") + ".example.com"
    deep = f"p:{host}/" + "/".join(map(str, range(12)))
    long = ".".join(["x"] * 120) + ".org"
    events = [("l", "block", "d:" + host, "add", day(1)), ("l", "allow", deep, "add", day(1)), ("l", "allow", "d:" + long, "add", day(1)), ("l", "block", f"p:{long}/a/b/c/d", "add", day(1))]
    urls = [f"http://{host}/", f"http://y.{host}/0", f"http://{host}/" + "/".join(map(str, range(11))), f"http://{host}/" + "/".join(map(str, range(20))), f"http://{long}/a/b/c", f"http://{long}/a/b/c/d/e"]
    captures = spark.createDataFrame([(i, u, day(2)) for i, u in enumerate(urls)], "page_id long, url string, fetched timestamp")
    got = {r.page_id: (r.decision, r.matched_key, r.n_matches) for r in urlfilter.filter_captures(captures, spark.createDataFrame(events, EVENTS)).collect()}
    assert got == {
        0: ("block", "d:" + host, 1), 1: ("block", "d:" + host, 1), 2: ("block", "d:" + host, 1), 3: ("allow", deep, 2),
        4: ("allow", "d:" + long, 1), 5: ("block", f"p:{long}/a/b/c/d", 2),
    }


def test_very_long_urls(spark):
    url = "http://example.com/" + "a/" * 3000 + "?" + "q" * 100_000
    captures = spark.createDataFrame([(1, url, day(2))], "page_id long, url string, fetched timestamp")
    events = spark.createDataFrame([("l", "block", "p:example.com" + "/a" * 3000, "add", day(1))], EVENTS)
    got = urlfilter.filter_captures(captures, events).head()
    assert got.decision == "block" and got.url == url
