"""Quality, shards, mixing, licences and perplexity against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import frame, prose, rows
from pyspark.sql import functions as F

from eventlab.llm import hilbert, licenses, mixing, perplexity, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_metrics(text):
    text = text or ""
    words, seen, repeated_lines, marked = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    symbols = sum(c in quality.SYMBOLS for c in text)
    return len(words), sum(map(len, words)), symbols, repeated_lines, len(marked)


def test_metrics(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "source")
    data = [*(tuple(r) for r in docs.collect()), *((1000 + i, r[1], r[3]) for i, r in enumerate(rows()))]
    data.append((2000, "a b c a b c\na b\n a b\na b\n\n\n# $ |", "x"))
    got = quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, source string"))
    found = {r.doc_id: r for r in got.collect()}
    for doc, text, _ in data:
        expected = plain_metrics(text)
        assert tuple(found[doc][m] for m in quality.METRICS) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert found[doc].base_failed == failed
        assert not (failed and found[doc].kept)


def test_host_verdicts(spark):
    good, bad, symbols = prose(1, 80), "short", prose(2, 80) + " #" * 80
    data = [(i, good, "clean") for i in range(60)] + [(100 + i, bad, "farm") for i in range(50)]
    data += [(200, good, "farm"), (201, symbols, "farm"), (202, symbols, "clean"), (203, good, None), (204, bad, "once")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    # Only on the distrusted host must a document pass the stricter rules, and clean ones stay even there.
    assert [found[i].kept for i in (200, 201, 202, 203, 204)] == [True, False, True, True, False]
    assert found[200].host_rate > 0.5 > found[0].host_rate
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, r in found.items() if r.kept}


def test_wide_margins_go_on_trusted_hosts(spark):
    """Hosts in the proportions of real tables: the verdict changes rows, and no clean document goes."""
    clean, light, heavy, lines = prose(1, 80), prose(2, 80) + " #" * 80, " ".join(f"{w}$$$" for w in prose(3, 80).split()), (prose(4, 5) + "\n") * 2
    lines = "".join(f"{prose(50 + i, 6)}\n" for i in range(12)) + lines * 8
    data = [(i, clean, f"host{i % 5}") for i in range(1000)]
    data += [(1000 + i, clean, "spammy") for i in range(40)] + [(1100 + i, light, "spammy") for i in range(20)]
    data += [(2000, light, "host0"), (2001, heavy, "host0"), (2002, heavy, None), (2003, lines, "spammy"), (2004, clean, None)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, source string")).collect()}
    assert found[0].host_trusted and not found[1000].host_trusted
    assert all(r.kept for r in found.values() if r.n_symbols == 0 and r.n_dup_lines == 0 and not r.base_failed)
    assert not any(found[1100 + i].kept or found[1100 + i].base_failed for i in range(20))
    assert [found[i].kept for i in (2000, 2001, 2002, 2003, 2004)] == [True, False, False, False, True]
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id bigint, text string, source string, host_trusted string, doc int")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_limit_follows_the_prior(spark):
    """Below the fixed limit, a host far above the others is distrusted; equal hosts are not."""
    failed = F.col("doc_id") < F.when(F.col("host") == "odd", 80).otherwise(10)
    rows_of = lambda names: spark.createDataFrame([(i, h) for h in names for i in range(1000)], "doc_id bigint, host string")
    hosts = [f"h{i}" for i in range(30)]
    found = {r.host: r for r in quality.host_verdicts(rows_of([*hosts, "odd"]), "host", failed).collect()}
    assert not found["odd"].host_trusted and found["odd"].host_rate < quality.MAX_HOST_RATE
    assert all(found[h].host_trusted for h in hosts)
    assert found["odd"].host_limit < quality.MAX_HOST_RATE
    assert all(r.host_trusted for r in quality.host_verdicts(rows_of(hosts), "host", failed).collect())


def test_prior_by_moments():
    rates = np.array([0.1, 0.3, 0.2, 0.6])
    n = np.array([50.0, 80.0, 100.0, 20.0])
    bad = rates * n
    mean, strength = quality.beta_prior(4, n.sum(), bad.sum(), (n * n).sum(), (bad * bad / n).sum())
    between = ((n * (rates - mean) ** 2).sum() - 3 * mean * (1 - mean)) / (n.sum() - (n * n).sum() / n.sum())
    assert mean == pytest.approx(bad.sum() / n.sum())
    assert strength == pytest.approx(mean * (1 - mean) / between - 1)
    assert quality.beta_prior(0, 0, 0, 0, 0) == (0.0, None)
    assert quality.beta_prior(1, 10, 5, 100, 2.5) == (0.5, None)


@pytest.mark.parametrize("dims,bits", [(2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = hilbert.curve_index(points, bits)
    assert sorted(place) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shards(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    placed = hilbert.assign(docs, shards=7).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    assert all(placed["size"] == [len(texts[i]) + 16 for i in placed["doc_id"]])
    assert all(placed["text_crc32"] == [zlib.crc32(texts[i]) for i in placed["doc_id"]])
    counts = placed.groupby("shard")["slot"].agg(["count", "min", "max"])
    assert list(counts.index) == list(range(7))
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()
    assert placed.sort_values(["shard", "slot"])["curve"].is_monotonic_increasing
    # The shards of the curve span fewer languages than those of a random order.
    both = placed.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    spans = both.groupby("shard")["lang"].nunique().mean()
    shuffled = both.assign(shard=both["shard"].sample(frac=1, random_state=0).to_numpy())
    assert spans < shuffled.groupby("shard")["lang"].nunique().mean()
    hilbert.write_shards(docs, f"{tmp_path}/out", shards=7)
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.count() == docs.count()
    assert sorted(written.toPandas()["shard"].value_counts()) == sorted(counts["count"])


def test_awkward_shards(spark):
    placed = hilbert.assign(frame(spark)).toPandas()
    # Fewer documents than shards: one each.
    assert sorted(placed["shard"]) == list(range(len(rows()))) and (placed["slot"] == 0).all()


def plain_targets(sizes):
    """By source in order: equal words per weight, capped at three times the size."""
    total, weight = sum(sizes), [1 + i % 3 for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        level = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if 3 * sizes[i] < weight[i] * level}
        if not over:
            for i in open_:
                out[i] = weight[i] * level
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def nearest(sizes, target):
    """How near any choice of documents can come, none taken more than three times."""
    whole = min(int(target // sum(sizes)), 3) if sum(sizes) else 0
    reach = {whole * sum(sizes)}
    for s in sizes if len(sizes) <= 12 and whole < 3 else []:
        reach |= {x + s for x in reach}
    return 0 if len(sizes) > 12 else min(abs(x - target) for x in reach)


@pytest.mark.parametrize("extra", [False, True])
def test_mix(spark, small_dir, extra):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "source")
    data = [tuple(r) for r in docs.collect()]
    if extra:
        data = data[:60] + [(1000 + i, r[1], r[3]) for i, r in enumerate(rows())] + [(2000, "tiny source", "zz")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mixing.mix(df).toPandas().merge(df.select("doc_id", "source").toPandas(), on="doc_id")
    size = defaultdict(int)
    for _, text, source in data:
        size[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    want = plain_targets([size[s] for s in names])
    for source, target in zip(names, want, strict=True):
        own = got[got["source"].isna()] if source is None else got[got["source"] == source]
        assert (own["source_size"] == size[source]).all()
        assert own["target"].iloc[0] == pytest.approx(target)
        assert abs(own["taken"].sum() - target) <= 1 + nearest(own["size"].tolist(), target)
    assert (got["taken"] <= 3 * got["size"]).all()
    assert (got["taken"] % got["size"].clip(lower=1) == 0).all()
    again = mixing.mix(df.repartition(5)).toPandas()
    columns = ["doc_id", "taken"]
    assert got[columns].sort_values(columns).to_numpy().tolist() == again[columns].sort_values(columns).to_numpy().tolist()
    often = Counter({r.doc_id: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()})
    assert all(often[r.doc_id] == (r.taken // r.size if r.size else 0) for r in got.itertuples())


def test_hot_cells_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 16)
    data = [(i, "five words are in here", "a" if i % 3 else "b") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string")).toPandas()
    sums = got.groupby("target")["taken"].sum()
    assert all(abs(taken - target) <= 5 for target, taken in sums.items())


def test_budgets_are_met():
    r = np.random.default_rng(1)
    for _ in range(200):
        sizes = np.unique(r.integers(1, 60, r.integers(1, 9)))
        counts = r.integers(1, 6, len(sizes))
        budget = int(r.integers(0, (sizes * counts).sum() + 10))
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            reach = {a + s * k for a in reach for k in range(c + 1)}
        best = min(abs(x - budget) for x in reach)
        exact = mixing.fill_budget(sizes, counts, budget)
        assert (0 <= exact).all() and (exact <= counts).all()
        got = int((exact * sizes).sum())
        assert abs(got - budget) == best
        # Above the knapsack's size, the same share of every length is taken first.
        more = mixing.fill_budget(sizes, counts * 1000, budget * 1000, knapsack=100)
        assert abs(int((more * sizes).sum()) - min(budget * 1000, int((counts * sizes).sum()) * 1000)) <= sizes.max()
    assert (mixing.fill_budget(np.array([0, 5]), np.array([3, 2]), 5) == [0, 1]).all()


def test_levels_compare_whole_texts(spark):
    """Texts that differ after long shared beginnings, beside frequent, equal, empty and missing ones."""
    r = np.random.default_rng(8)
    hosts = [f"http{'s' if i % 2 else ''}://www.{'shared-name-' * 3}{i:03d}.example" for i in range(60)]
    texts = [*r.choice(hosts, 400), *["http://www.hot.example"] * 300, "", "\u00e9", "\U0001f600", "z" * 5000, None, None]
    sizes = [int(x) for x in r.integers(0, 1000, len(texts))]
    df = spark.createDataFrame(list(zip(map(lambda t: None if t is None else str(t), texts), sizes, strict=True)), "source string, size bigint")
    bits = 4
    made = hilbert.levels(df, ["source", "size"], bits)
    got = {(x.source, x.level) for x in df.select("source", made[0].alias("level")).collect()}
    ordered = sorted((str(t) for t in texts if t is not None), key=lambda t: t.encode())
    edges = [ordered[math.ceil(i * len(ordered) / 2**bits) - 1].encode() for i in range(1, 2**bits)]
    assert got == {(None if t is None else str(t), 0 if t is None else sum(str(t).encode() > e for e in edges)) for t in texts}
    # The hosts are told apart: far more than the two beginnings.
    assert len({level for _, level in got}) >= 8
    none = spark.createDataFrame([(None, 1)], "source string, size bigint")
    assert none.select(*hilbert.levels(none, ["source", "size"], bits)).collect()[0][0] == 0


def plain_places(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in licenses.PHRASES.items():
        phrase = phrase.split()
        found += [(i, label) for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
    return len(words), found


def test_license_places(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    data = [*(tuple(r) for r in docs.collect()), *((1000 + i, r[1]) for i, r in enumerate(rows()))]
    data += [(2000, "Under the under the MIT license under the mit LICENSE"), (2001, "cc by NC cc_by_nc cc by-nc ccby nc")]
    got = licenses.summary(licenses.scan(spark.createDataFrame(data, "doc_id bigint, text string")))
    texts = defaultdict(list)
    for doc, text in data:
        texts[doc].append(text)
    for r in got.collect():
        n, places = plain_places(texts[r.doc_id][0])
        at = [i for i, _ in places]
        base = sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(base)
        assert set(base) <= set(r.labels.split(",") if r.labels else [])
        assert 0 <= r.score <= 1


def test_license_spans(spark):
    mit = licenses.TEMPLATES["mit"].split()
    changed = mit[:20] + ["really"] + mit[20:45] + mit[48:]
    texts = [(0, "intro words " + " ".join(changed) + " the end"), (1, " ".join(reversed(mit))), (2, " ".join(mit[:12]))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    (span,) = got[0].spans
    assert (span.label, span.start) == ("mit", 2) and span.share > 0.9
    assert got[1].spans == [] and got[2].spans == []


@pytest.mark.parametrize("phrases", [{"gpl licensed": "gpl", "mit": "mit"}, {"mit": "mit"}, {"a b c d": "four", "b c": "two", "c": "one"}])
@pytest.mark.parametrize("templates", [None, {}])
def test_short_phrases(spark, phrases, templates):
    """Phrases of one and two words, beside templates and alone, at the ends of texts and in a row."""
    r = np.random.default_rng(3)
    pool = ["gpl", "licensed", "mit", "a", "b", "c", "d", "other", "free", "software"]
    texts = [(i, " ".join(r.choice(pool, int(n)))) for i, n in enumerate(r.integers(0, 40, 60))] + [(100, "gpl"), (101, "licensed"), (102, "MIT"), (103, None)]
    scanned = licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), templates, phrases)
    got = {x.doc_id: sorted((p.word, p.label) for p in x.places) for x in scanned.collect()}
    for doc, text in texts:
        words = (text or "").lower().split()
        split = {tuple(p.split()): label for p, label in phrases.items()}
        assert got[doc] == sorted((i, label) for p, label in split.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)


def test_phrases_without_words_are_refused():
    with pytest.raises(ValueError, match="no word"):
        licenses.model((), (("--", "x"),))


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_every_notice_gets_its_own_label(spark, label):
    notice = licenses.TEMPLATES[label]
    words = notice.split()
    changed = " ".join(words[: len(words) // 2] + ["inserted"] + words[len(words) // 2 :])
    other = licenses.TEMPLATES["isc" if label == "mit" else "mit"]
    texts = [(0, notice), (1, f"Copyright some one. {changed} More text."), (2, f"{notice} and {other}")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [s.label for s in got[0].spans] == [label] and got[0].spans[0].share == 1.0
    assert [s.label for s in got[1].spans] == [label]
    assert [s.label for s in got[2].spans] == [label, "isc" if label == "mit" else "mit"]


def test_matching_statistics():
    model = licenses.model((("a b c a b d", "x"), ("b c a c", "y")), (("a b c", "p"),))
    known = {v: k.decode() for k, v in model.vocabulary.items()}
    runs = {tuple(t[i:j]) for t in ("abcabd", "bcac", "abc") for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    r = np.random.default_rng(2)
    for _ in range(100):
        tokens = r.integers(1, 5, 30).tolist()
        text = [known[t] for t in tokens]
        for i, (_, length) in enumerate(model.automaton.stream(iter(tokens))):
            assert length == max((k for k in range(1, 8) if tuple(text[max(0, i - k + 1) : i + 1]) in runs and k <= i + 1), default=0)


def plain_model(texts):
    order, counts = perplexity.ORDER, {perplexity.ORDER: Counter()}
    for text in texts:
        data = bytes(order - 1) + text.encode()
        counts[order].update(data[i - order + 1 : i + 1] for i in range(order - 1, len(data)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
    total, weight, taken = (defaultdict(lambda: defaultdict(float)) for _ in range(3))
    for n, table in counts.items():
        taken[n] = perplexity.discounts(*[sum(v == i for v in table.values()) for i in (1, 2, 3, 4)])
        for k, v in table.items():
            total[n][k[:-1]] += v
            weight[n][k[:-1]] += taken[n][min(v, 3) - 1]

    def probability(key):
        p = 1 / 256
        for n in range(1, order + 1):
            own = key[order - n :]
            t = total[n].get(own[:-1])
            if t:
                v = counts[n].get(own, 0)
                p = ((v - taken[n][min(v, 3) - 1]) if v else 0) / t + weight[n][own[:-1]] / t * p
        return p

    return probability


def test_perplexity(spark):
    trusted = {i: prose(i, 60, words=5) for i in range(20)}
    others = {100: prose(30, 60, words=5), 101: "#%& ZZZ !!" * 20, 102: "é", 103: "", 104: None}
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in (trusted | others).items()], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in trusted] + [(None,), (999,), (3,)], "doc_id bigint")
    got = {r.doc_id: r for r in perplexity.classify(docs, labels).collect()}
    held = {r.doc_id for r in labels.selectExpr("doc_id", f"pmod(xxhash64(3, doc_id), {perplexity.HELD_OUT}) = 0 AS held").where("held").collect()}
    assert held & set(trusted)
    p = plain_model([t for i, t in trusted.items() if i not in held])
    assert sum(p(b"\0mo" + b"n" + bytes([x])) for x in range(256)) == pytest.approx(1)
    for i, text in (trusted | others).items():
        if not text:
            assert got[i].perplexity is None and not got[i].kept
            continue
        data = bytes(perplexity.ORDER - 1) + text.encode()
        logs = [math.log(p(data[j : j + perplexity.ORDER])) for j in range(len(text.encode()))]
        assert got[i].perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
        for n in perplexity.WINDOWS:
            runs = [sum(logs[j : j + n]) / n for j in range(len(logs) - n + 1)] or [sum(logs) / len(logs)]
            assert got[i][f"worst_{n}"] == pytest.approx(math.exp(-min(runs)), rel=1e-4)
        assert got[i].kept == all(got[i][m] <= got[i][t] for m, t in (("perplexity", "threshold"), ("worst_64", "worst_64_threshold"), ("worst_8", "worst_8_threshold")))
    for lang in ("en", "de"):
        mine = [r.worst_8 for i, r in got.items() if i in held and r.lang == lang]
        assert mine and {r.worst_8_threshold for r in got.values() if r.lang == lang} == {max(mine)}
    assert not got[101].kept
    assert sum(got[i].kept for i in held) == len(held)


def test_worst_runs():
    r = np.random.default_rng(4)
    sizes = np.array([0, 3, 8, 9, 40, 0, 1, 100, 8, 0])
    logs, ends = r.integers(-9, 0, sizes.sum()), np.cumsum(sizes)
    sums = np.r_[0, np.cumsum(logs)]
    for n in (1, 8, 64, 500):
        got = perplexity.worst_runs(sums, ends, sizes, n)
        for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
            runs = [logs[j : j + n].mean() for j in range(a, b - n + 1)] or ([logs[a:b].mean()] if b > a else [0])
            assert got[i] == pytest.approx(min(runs))


def test_a_strange_passage_in_a_long_text(spark):
    """A passage or a word that trusted texts never have is found, however long the rest is."""
    trusted = {i: prose(i, 200, words=5) for i in range(60)}
    long = prose(99, 4000, words=5)
    others = {100: long, 101: long + " " + "zzkx qqvw jjpy " * 6 + long, 102: long + " wxyzzyxw " + long}
    docs = spark.createDataFrame([(i, t, "en") for i, t in (trusted | others).items()], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in perplexity.classify(docs, docs.where("doc_id < 60").select("doc_id")).collect()}
    assert got[101].worst_64 > got[101].worst_64_threshold and not got[101].kept
    assert got[102].worst_8 > got[102].worst_8_threshold and not got[102].kept
    assert got[102].perplexity < 1.01 * got[100].perplexity


def test_perplexity_without_trusted_documents(spark):
    docs = spark.createDataFrame([(1, "some text", None), (1, "some text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    got = perplexity.classify(docs, docs.where("doc_id > 5").select("doc_id")).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, True), (1, True), (2, False)]
