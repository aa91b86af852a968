"""Revisits against a plain search."""

import pytest

from eventlab.llm import revisits

SCHEMA = "record_id bigint, url string, at bigint, kind string, headers map<string,string>, body string"


@pytest.mark.parametrize(
    "url,key",
    [
        ("HTTP://WWW.Example.org:80/a/index.html#x", "example.org/a"),
        ("https://example.org/a/?utm_source=f&b=2&a=1", "example.org/a?a=1&b=2"),
        ("https://example.org", "example.org"),
        ("http://example.org/?ref=x", "example.org"),
        ("https://example.org/Case.html", "example.org/Case"),
        (None, None),
    ],
)
def test_canonical(spark, url, key):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(revisits.canonical_url(df["url"])).first()[0] == key


def plain(records):
    out = {}
    keys = {"http://a/x": "a/x", "https://a/x#f": "a/x", "http://b/": "b", None: None}
    for r in records:
        if r[3] != "revisit" or r[2] is None:
            continue
        own = r[4] or {}
        before = [x for x in records if x[3] == "response" and x[2] is not None and keys[x[1]] == keys[r[1]] and (x[2], x[0]) < (r[2], r[0])]
        if keys[r[1]] is None or not before:
            out[r[0]] = (None, "no_response", None, None)
            continue
        found = max(before, key=lambda x: (x[2], x[0]))
        theirs = found[4] or {}
        tags = [(h.get("etag") or "").removeprefix("W/") for h in (own, theirs)]
        dates = [h.get("last-modified") for h in (own, theirs)]
        agree = tags[0] == tags[1] if all(tags) else dates[0] == dates[1] if all(dates) else True
        if not agree:
            out[r[0]] = (found[0], "mismatch", None, None)
        else:
            update = {k: v for k, v in own.items() if k in revisits.UPDATABLE}
            out[r[0]] = (found[0], "resolved", theirs | update, found[5])
    return out


def test_resolve(spark):
    import random

    r = random.Random(5)
    records = []
    for i in range(400):
        url = r.choice(["http://a/x"] * 5 + ["https://a/x#f", "http://b/", None])
        headers = {k: v for k, v in (("etag", r.choice(['"1"', 'W/"1"', '"2"'])), ("last-modified", r.choice(["mon", "tue"])), ("date", str(i)), ("content-length", "9")) if r.random() < 0.7}
        kind = r.choice(["response", "revisit", "revisit", "request"])
        records.append((i, url, r.choice([None, *range(60)]), kind, headers or None, f"body {i}" if kind == "response" else None))
    got = revisits.resolve(spark.createDataFrame(records, SCHEMA).repartition(5)).collect()
    found = {x.record_id: (x.response_id, x.status, x.headers, x.body) for x in got}
    assert len(got) == len(found)
    assert found == plain(records)
    assert {s for _, s, _, _ in found.values()} == {"resolved", "mismatch", "no_response"}
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_captures(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    records = revisits.capture_records(pages)
    assert records.count() == 2 * pages.count()
    out = revisits.digest(revisits.resolve(records)).toPandas()
    assert len(out) == pages.count() and (out["status"] != "no_response").all()
