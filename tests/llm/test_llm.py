"""The operators on small tables against plain versions: null, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import collections
import hashlib
import html
import random
import re
import struct
import zlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plantwave.llm import ann, bpe, chat, components, jaccard, langid, packing, pages, quality, queries, shingles, url_filter, warc

DOC = "doc_id long, text string, lang string, path string, offset int, n int"
ODD = ["", None, " \n\t", "a", "one two", "Łódź naïve\u2003x\u3000東京 🙂", "x" * 5000, "end\n", "it's  we'll\r\n\n 12,345 <|endoftext|>", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one of them twice, beside columns with clashing names."""
    rows = [(i, t, None if i % 2 else "en", "p", 7, 3) for i, t in enumerate([*ODD, ODD[4]])]
    return spark.createDataFrame([*rows, (3, "a", "en", None, None, None), (None, "no id", None, None, None, None)], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(df):
    return [tuple(r) for r in df.collect()]


def same_as_sql(df, found):
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    assert sorted(map(repr, rows(df.select(*columns)))) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


# --- fixity audit


def test_audit_equals_sql(spark, sf, duck):
    same_as_sql(queries.op1_warc_fixity_audit(spark, sf), duck.sql(queries.OP1_SQL))


def test_audit_of_odd_rows(spark, odd, none):
    whole = warc.manifest(odd, 4)
    assert warc.audit(whole, warc.manifest(odd, 4), 256, 16).count() == 0
    changed = warc.manifest(odd.withColumn("text", F.when(F.col("doc_id") == 6, "y" * 5000).otherwise(F.col("text"))).where("doc_id is not null"), 4)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["status"]) for r in warc.audit(whole, changed, 256, 16).collect()) == [(False, 6, "changed"), (True, None, "missing")]
    assert {r["status"] for r in warc.audit(warc.manifest(none), whole).collect()} == {"extra"}
    assert warc.audit(warc.manifest(none), warc.manifest(none)).count() == 0


def test_audit_descends_only_into_bad_branches(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
    for gone, stored in (([1234], F.when(F.col("doc_id") == 1234, F.reverse("text")).otherwise(F.col("text"))), ([77, 3001], F.when(~F.col("doc_id").isin(77, 3001), F.col("text")))):
        one, two = warc.sides(warc.manifest(docs, stored=stored))
        assert sorted(r["doc_id"] for r in warc.audit(one, two, 1024, 4).collect()) == gone
        bad, visited = warc.descend(one, two, 1024, 4)
        assert bad.count() == len(gone) and visited <= len(gone) * 4 * 8 < warc.ranges(one, 1024).count()


def test_audit_names_the_lost_one_of_equal_neighbours(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "x"), (2, "x"), (3, "b")], "doc_id long, text string")
    one, two = warc.sides(warc.manifest(docs, stored=F.when(F.col("doc_id") != 1, F.col("text"))))
    assert [(r["doc_id"], r["status"]) for r in warc.audit(one, two, 1, 2).collect()] == [(1, "missing")]
    shifted = warc.manifest(docs.where("doc_id <> 1"))  # a replica with an index of its own
    assert {(r["doc_id"], r["status"]) for r in warc.audit(one, shifted, 1, 2).collect()} == {(1, "missing"), (2, "changed"), (3, "changed")}


# --- URL filter


def test_urls_equal_sql(spark, sf, duck):
    same_as_sql(queries.op2_url_filter(spark, sf), duck.sql(queries.OP2_SQL))


URLS = [None, "", "no scheme/en/", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://www.example.com/en", "ftp://badexample.com/en/", "http://a.net/es/?x", "http://a.net/ES/", "http://net/fr/q", "http://a.com", "http://a.com/", "http://x.org/login", "http://x.org/cgi-bin/a", "x://y.net?/es/", "http://a.org/?session=1", "http://a.com://b.net/es/"]


def test_urls_fetch_only_rules_of_their_tokens(spark):
    rules = [url_filter.host_path_rule("block", f"site{i}.com", f"/p{i % 7}/") for i in range(2000)] + [url_filter.pattern_rule("block", "x{40}", [])]
    urls = spark.createDataFrame([(f"http://a.site{i}.com/p{i % 5}/",) for i in range(30)] + [("http://" + "long/" * 30_000 + "site3.com",)], "url string")
    urls = urls.withColumn("_target", url_filter.url_parts("url")[2])
    index = url_filter.index_rules(urls, rules, "_target")
    assert {t for t, part in index.items() for r in part} >= {"site3", ""} and len(index) > 1000
    for r in urls.withColumn("c", url_filter.candidates(index, rules, "_target")).collect():
        tokens = {*re.findall("[A-Za-z0-9]+", r["_target"]), ""}
        assert sorted(c["text"] for c in r["c"]) == sorted(x.text for t in tokens for x in index.get(t, []))
        assert len(r["c"]) <= 2
    judged = url_filter.filter_urls(urls.select("url"), rules)
    assert [r["rule"] for r in judged.limit(6).collect()] == [f"site{i}.com/p{i % 7}/" if i % 5 == i % 7 else None for i in range(6)]
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()


def test_urls_are_counted_through_buckets(spark):
    """What a URL's token is compared with does not grow with the rules, and the rarest token is the one brute force counts."""
    for n in (10, 1000, 4000):
        rules = [url_filter.host_path_rule("block", f"site{i}.com", f"/p{i % 7}/") for i in range(n)]
        buckets, size = url_filter.known_tokens(rules)
        assert sum(map(len, buckets)) == len({t for r in rules for t in r.tokens}) and max(map(len, buckets)) <= 7 and size == len(buckets)
    texts = [f"http://a.site{i % 9}.com/p{i % 5}/com" for i in range(60)]
    urls = spark.createDataFrame([(t,) for t in texts], "url string").withColumn("t", url_filter.url_parts("url")[2])
    index = url_filter.index_rules(urls, rules[:40], "t")
    count = lambda t: sum(t in re.findall("[A-Za-z0-9]+", u.split("://")[1]) for u in texts)
    for token, part in index.items():
        assert all(token == min(r.tokens, key=lambda t: (count(t), t)) for r in part)


def test_urls_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([("http://a.com/x", 1, 2, 3, 4, "h")], "url string, _target int, _best int, _rest int, `a.b` int, Host string")
    got = url_filter.filter_urls(df, queries.URL_RULES)
    assert got.columns == ["url", "_target", "_best", "_rest", "a.b", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == ("http://a.com/x", 1, 2, 3, 4, "a.com", "/x", "com/", "allow")


def test_urls_one_by_one(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*URLS, URLS[3]])], "page_id int, url string, host string")
    got = url_filter.filter_urls(df, queries.URL_RULES + queries.PAGE_PATTERNS).orderBy("page_id").collect()
    for r, url in zip(got, [*URLS, URLS[3]], strict=True):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        fits = [x for x in queries.URL_RULES if (h := x.text.partition("/"))[0] in (host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")) and path.startswith("/" + h[2])]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert r["rule"] == (best.text if best else r["rule"]) and (not best or r["verdict"] == best.verdict), url
    by_url = {r["url"]: r["verdict"] for r in got}
    assert by_url["http://x.org/login"] == by_url["http://x.org/cgi-bin/a"] == by_url["http://a.org/?session=1"] == "block" and by_url[None] == "allow"
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


# --- packing


def check_packing(got, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    want = collections.Counter()
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, n, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r["length"] for r in got) / capacity


def test_packing(spark, docs, odd, none):
    made, least = check_packing(packing.pack_documents(docs, queries.TOKENIZER).collect(), rows(docs.select("doc_id", "text")))
    assert made <= 1.03 * least + 2
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "<|endoftext|>" * 40), (3, " \n<|endoftext|> \n\n x")], "doc_id long, text string")
    check_packing(packing.pack_documents(special, queries.TOKENIZER, 16, 2).collect(), rows(special), 16)
    check_packing(packing.pack_documents(odd.repartition(3), queries.TOKENIZER, 64, 2).collect(), rows(odd.select("doc_id", "text")), 64)
    assert packing.pack_documents(none, queries.TOKENIZER).count() == 0


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4, 5, 5, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 5), (3, 0)]
    fit = packing.BestFit(10, 2)
    for n in (9, 8, 7):
        fit.place(n)
    assert fit.count == 2 and fit.place(1)[0] == 1  # the bin with one free token was closed


# --- nearest neighbours


def test_neighbours_recall(spark, sf, duck):
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in queries.op4_nearest_neighbours(spark, sf).collect()}
    want = {(q, v): s for q, _, v, s in duck.sql(f"select query_id, \"rank\", vec_id, score from ({queries.OP4_SQL})").fetchall()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(s == pytest.approx(want[k], abs=1e-12) for k, s in got.items() if k in want)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    copies = [(1000 + i, good[0][1]) for i in range(50)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0, None] + [0.0] * 6), (2004, [float("inf")] * 8), (2005, [1.0]), (None, [1.0] * 8), (2006, [])]
    df = spark.createDataFrame([(*x, "r") for x in good + copies + bad], "vec_id long, embedding array<double>, rank string")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.expr("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    known = good + copies
    ids, matrix = np.array([i for i, _ in known]), np.array([v for _, v in known])
    right = total = 0
    for q, v in known:
        if q % 20 == 0:
            scores = matrix @ np.array(v)
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
            assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 20
            right += len({int(ids[i]) for i in order} & {x for x, _ in got[q]})
            total += 20
    assert right >= 0.95 * total and set(got) == {q for q, _ in known if q % 20 == 0}
    few = df.where("vec_id < 3")
    assert ann.nearest(few, F.lit(True), 20).count() == 6
    assert ann.nearest(df.limit(0), F.lit(True), 20).count() == 0


def test_neighbours_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 2.0]), (5, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = collections.Counter(map(tuple, ann.nearest(df, F.expr("vec_id = 0"), 2).collect()))
    assert got == {(0, 1, 0, 1.0): 2, (0, 2, 3, 1.0): 2, (0, 1, 3, 2.0): 1, (0, 2, 5, 2.0): 1}


def test_neighbours_rerank_few(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 40 * 64 * 8)
    vectors = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    found, work = ann.search(vectors, F.expr("vec_id % 20 = 0"), 20, "vec_id", "embedding", ann.EPS)
    done = work.agg(F.sum("reranked"), F.sum("compared")).first()
    queries_, n = vectors.where("vec_id % 20 = 0").count(), vectors.count()
    assert done[1] == queries_ * n and done[0] < 0.3 * done[1]  # of 2000 rows; 0.03 of 51 000
    ids, matrix = (np.array([r[i] for r in vectors.select("vec_id", "embedding").collect()], t) for i, t in ((0, np.int64), (1, np.float64)))
    scores = matrix[ids % 20 == 0] @ matrix.T
    scores[np.arange(len(scores)), np.flatnonzero(ids % 20 == 0)] = -np.inf
    best = {(int(q), int(v)) for q, row in zip(ids[ids % 20 == 0], scores, strict=True) for v in ids[np.argsort(-row)[:20]]}
    assert len(best & {(r["query_id"], r["vec_id"]) for r in found.collect()}) >= 0.95 * len(best)


def test_bit_products_equal_products():
    rng = np.random.default_rng(2)
    vectors, mean = rng.normal(size=(50, 24)), np.full(24, 0.1)
    turn = ann.rotation(24, 256)
    codes, length, correction = ann.encode(vectors, mean, turn)
    q = ann.Query(0, 0, rng.normal(size=24), mean, turn)
    part = ann.Batch(np.arange(50), np.arange(50), vectors, codes, length, correction, 1.0)
    bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
    turned = turn @ q.vector
    levels = np.rint((turned - q.low) / q.step)
    assert (q.common(part.words, *part.room) == bits @ levels).all()
    assert np.allclose(((vectors - mean) @ turn.T > 0), bits)
    estimate = q.base + length * ((2.0 * bits - 1) @ turned) / (16 * correction)
    assert np.abs(estimate - vectors @ q.vector).max() < 4 * q.norm * np.sqrt(1 - correction**2).max() / correction.min() * length.max() / 16


# --- quality rules


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, odd, none):
    df = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text"))
    texts = rows(df)
    got = rows(quality.judge(df, None))
    assert sorted(r[:6] for r in got) == sorted((d, *measured(t)) for d, t in texts)
    for r in got:
        assert r[7] == (r[1] < 20 or 100 * r[5] > 30 * r[1]) and r[8] == (not r[7])
    assert quality.judge(none, None).count() == 0 and quality.judge(odd, None).count() == odd.count()


def test_quality_verdicts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    field = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    judged = quality.judge(docs.where("doc_id % 2 = 1"), field).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in judged]) >= 0.95
    assert quality.fit(docs, labels.limit(0)) is None
    kept = quality.keep_content(docs, field)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    shares = [r["content_share"] for r in quality.judge(docs, field).where("not base_failed").collect()]
    assert sum(0 < s < 1 for s in shares) >= 0.01 * len(shares)
    texts = docs.join(labels, "doc_id").where("doc_id % 2 = 1").orderBy("doc_id").select("quality", "text").collect()
    lines = [[x for q, t in texts if q == want for x in t.split("\n") if 8 <= len(x.split()) <= 60 and fits(x)] for want, fits in ((1, lambda x: "|" not in x), (0, lambda x: x.count("|") > 5 or x.count("!!") > 5))]
    mixed = ["\n".join(lines[0][9 * i : 9 * i + 8] + lines[1][9 * i : 9 * i + n]) for i, n in enumerate((0, 3, 6, 9))]
    right = np.concatenate([np.append(y[:8] == 1, y[8:] == 0) for y in (field.decode(f) for *_, f in quality.measure(pa.array(mixed)))])
    assert right.mean() >= 0.9 and all(len(x) > 40 for x in lines)
    shares = [r[5] for r in quality.verdicts(pa.array(mixed), field)]
    assert shares[0] == 1 and sum(0 < s < 1 for s in shares) >= 2
    odd = pa.array([None, "", mixed[0] * 500, "\n" * 300, mixed[1] + "\n\n\n" + "x" * 200_000])
    assert [r[-1] for r in quality.verdicts(odd, field)][:2] == [False, False] and len(list(quality.verdicts(odd, field))) == 5


def test_lines_give_way_to_the_share_of_their_document():
    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=len(quality.FEATURES)).astype(np.float32), np.zeros((2, 2)))
    for _ in range(50):
        f = rng.normal(size=(9, len(quality.FEATURES))).astype(np.float32)
        f[:, 1] = np.log1p(rng.integers(1, 30, 9)) / 5
        words = np.expm1(5 * f[:, 1])
        for q in (0, 1):
            label, free = quality.within_share(q, f, field), field.decode(f)
            assert (label @ words >= quality.CONTENT_SHARE * words.sum()) == bool(q)
            changed = label != free
            assert not changed.any() or (free @ words >= quality.CONTENT_SHARE * words.sum()) != bool(q)
            assert (label[changed] == q).all()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        features, field = rng.normal(size=(n, 3)), quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
        score = lambda y: sum(float(features[i] @ field.weights) * y[i] for i in range(n)) + sum(field.pairs[y[i - 1], y[i]] for i in range(1, n))  # noqa: E731, B023
        best = max(score([k >> i & 1 for i in range(n)]) for k in range(2**n))
        assert score(field.decode(features).tolist()) == pytest.approx(best)


# --- language


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(docs)
    got = langid.identify(docs.where(langid.held_out(F.col("doc_id"))), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = model.documents([None, "", "12 34 !?", "   \n", "the and of the that"])
    assert [x for x, _ in odd[:4]] == ["und"] * 4 and odd[4][0] in model.languages
    long_ = model.documents(["the and of her was " * 30_000])
    assert long_[0][0] in model.languages
    kept = langid.keep_languages(docs, model, 0.35)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()


def scalar_document(model, text):
    """(language, score) of a text: the gates, states and pooled labels one number at a time."""
    raw, size = text.encode(), langid.WINDOW
    one = lambda x: 1 / (1 + np.exp(-float(x)))

    def states(unit, data):
        hidden = unit.weights.shape[0]
        state, out = [0.0] * hidden, []
        for byte in data:
            a = [sum(state[i] * float(unit.weights[i, j]) for i in range(hidden)) for j in range(3 * hidden)]
            x = unit.table[byte]
            z = [one(x[j] + a[j]) for j in range(hidden)]
            r = [one(x[hidden + j] + a[hidden + j]) for j in range(hidden)]
            new = [np.tanh(float(x[2 * hidden + j]) + r[j] * a[2 * hidden + j]) for j in range(hidden)]
            state = [(1 - z[j]) * new[j] + z[j] * state[j] for j in range(hidden)]
            out.append(state)
        return out

    sums = [0.0] * len(model.languages)
    for at in range(0, len(raw), size):
        data = raw[at : at + size].ljust(size, b"\0")
        ahead, back = states(model.forward, data), states(model.backward, data[::-1])[::-1]
        for t, byte in enumerate(data):
            if chr(byte).isascii() and not chr(byte).isalpha():
                continue
            both = [*ahead[t], *back[t], 1.0]
            scores = [sum(v * float(w) for v, w in zip(both, model.out[:, c], strict=True)) for c in range(len(sums))]
            parts = [np.exp(v - max(scores)) for v in scores]
            sums = [s + p / sum(parts) for s, p in zip(sums, parts, strict=True)]
    best = max(range(len(sums)), key=lambda c: sums[c])
    return model.languages[best], sums[best] / sum(sums)


def test_language_equals_scalar_network(spark, docs, odd):
    model = langid.train([("a", b"the and of that with"), ("b", "über schön für".encode()), ("c", b"de la que los")], hidden=3, steps=15, batch=6)
    texts = [r[0][:300] for r in docs.where("text is not null").orderBy("doc_id").limit(4).select("text").collect()] + ["a", "日本語 naïve", "x" * 129, "1 é 2"]
    for t, (lang, score) in zip(texts, model.documents(texts), strict=True):
        want = scalar_document(model, t)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4)
    got = langid.identify(odd, model).collect()
    plain = {t: model.documents([t])[0] for t in {r[1] for r in rows(odd)}}
    assert len(got) == odd.count() and sorted(((r["doc_id"], r["lang_pred"]) for r in got), key=repr) == sorted(((r["doc_id"], plain[r["text"]][0]) for r in odd.collect()), key=repr)
    assert plain[None] == plain[""] == plain[" \n\t"] == ("und", 0.0)
    assert langid.keep_languages(odd, model, 0.0).count() == sum(p[0] != "und" for p in [plain[r["text"]] for r in odd.collect()])


def test_language_without_labels(odd, none):
    model = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    unit = langid.Unit(rng.normal(0, 0.5, (256, 9)).astype(np.float64), rng.normal(0, 0.5, (3, 9)).astype(np.float64))
    text, goal = rng.integers(0, 256, (5, 2)), rng.normal(size=(5, 2, 3))

    def loss(u):
        state, total = np.zeros((2, 3)), 0.0
        for t, row in enumerate(text):
            x, a = u.table[row], state @ u.weights
            z, r = (1 / (1 + np.exp(-(x[:, i : i + 3] + a[:, i : i + 3]))) for i in (0, 3))
            state = (1 - z) * np.tanh(x[:, 6:] + r * a[:, 6:]) + z * state
            total += (state * goal[t]).sum()
        return total

    _, grad = unit.learn(text, unit.read(text), goal)
    for i, j in ((0, 0), (1, 4), (2, 8)):
        up, down = (langid.Unit(unit.table, unit.weights.copy()) for _ in range(2))
        up.weights[i, j] += 1e-5
        down.weights[i, j] -= 1e-5
        assert grad[i, j] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-3)


# --- byte-level BPE


BLOBS = ["x" * 5000 + " and on. " * 400 + "y" * 3000 + "\n\n12 it's", "z" * 9000, ("word " * 50 + "q" * 700) * 9, " " * 3000 + "a" + "\n" * 3000]


@pytest.mark.parametrize("chunk, overlap, stretch", [(bpe.CHUNK, bpe.OVERLAP, bpe.STRETCH), (50, 20, 1 << 16), (50, 20, 400), (7, 3, 90)])
def test_bpe(spark, docs, odd, chunk, overlap, stretch):
    with open(queries.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(BLOBS)], "doc_id long, text string"))
    df = df if chunk < 1000 else docs.select("doc_id", "text").unionByName(df)
    got = rows(bpe.digests(bpe.decode(bpe.encode_documents(df, queries.RANKS, queries.PATTERN, chunk, overlap, stretch), queries.RANKS, queries.PATTERN)))
    want = []
    for d, t in rows(df.select("doc_id", "text")):
        ids = encoding.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_cuts_every_text_and_goes_on_after_a_huge_word(docs):
    texts = [r[0] for r in docs.select("text").collect() if r[0] and len(r[0]) > 2 * bpe.CHUNK]
    assert texts and all(len(bpe.cut_points(t, queries.PATTERN)) - 1 == -(-len(t) // bpe.CHUNK) for t in texts)
    blob = BLOBS[0]
    cuts = bpe.cut_points(blob, queries.PATTERN, 50, 20)
    assert max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) < 8000 and len(cuts) > 40 and min(cuts[1:]) >= 5000
    assert bpe.stitch([(0, [], [52, 55]), (50, [55, 60], [101]), (100, [102], [150]), (150, [150], [])]) == ([0, 50, 150], [0, 55, 150], True)


@pytest.mark.parametrize("gap", ["\n\n", "\t\t\n", " \n", "\u2003\u2003"])
def test_bpe_of_white_space_at_the_seam(spark, gap):
    texts = [" ab" * 10 + "x" * k + "." + gap + "foo bar, it's" + " cd" * 40 for k in range(70)]
    ranks = bpe.rank_file(queries.RANKS, queries.PATTERN)
    assert [t for t in texts if bpe.encode_text(t, ranks, 64, 32) != ranks.ids(t)] == []
    got = dict(rows(bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.RANKS, queries.PATTERN, 32, 16, 64)))
    assert [i for i, t in enumerate(texts) if bytes(got[i]) != ranks.ids(t)] == []


def test_bpe_of_no_rows(none):
    assert bpe.encode_documents(none, queries.RANKS, queries.PATTERN).count() == 0


def test_tokenizer_file_equals_rank_file(docs):
    texts = [r[0] for r in docs.select("text").limit(50).collect()] + [t or "" for t in ODD]
    a, b = packing.tokenizers_file(queries.TOKENIZER), bpe.rank_file(queries.RANKS, queries.PATTERN)
    assert all(a.ids(t) == b.ids(t) for t in texts if "<|endoftext|>" not in t)
    library = Tokenizer.from_file(queries.TOKENIZER)
    for t in [*texts, "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x \n<|endoftext|>\n\n", "<|endoftext", "  <|endoftext|>  y"]:
        assert a.ids(t) == np.array(library.encode(t, add_special_tokens=False).ids, np.uint32).tobytes(), t
    assert public_tokenizers.PATTERN == queries.PATTERN


# --- chat


def test_chat(spark, sf):
    said = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r["conv_id"]: tuple(r) for r in queries.op8_chat_windows(spark, sf).collect()}
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows(said) + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        talks[c].append((turn, role, text or ""))
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert got[c][1:5] == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


NASTY = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|im_end|> [\\INST]", "</s>[INST] ok [/INST]<<SYS>>\\", "", None, "\n\n", "<" * 5 + "s>"]


def test_chat_escapes_and_windows(spark):
    rows_ = [(1, i, ("system", "user", "assistant")[min(i, 1 + i % 2)] if i else "system", t) for i, t in enumerate(NASTY * 6)]
    rows_ += [(2, 0, None, None), (2, 0, "assistant", "tie"), (2, None, "assistant", "first"), (None, 1, "a\nb\\n<s>", "x"), (3, 0, "assistant", "long " * 2000)]
    df = spark.createDataFrame([(*r, "w") for r in rows_], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_conversations(df, queries.RANKS, queries.PATTERN, 200, 90)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    talks = collections.defaultdict(list)
    for c, turn, role, text in rows_:
        talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["n_turns"] == len(turns)
    first = [r for r in windows.collect() if r["conv_id"] == 1]
    assert len(first) > 3 and all(chat.parse(r["text"])[0][0] == "system" for r in first) and any(r["n_repeated"] > 1 for r in first)
    assert all(r["n_tokens"] <= 200 or r["n_turns"] - r["n_repeated"] == 1 for r in first)
    assert chat.read_back(chat.format_conversations(df.limit(0), queries.RANKS, queries.PATTERN)).count() == 0


def test_escaping_is_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "s>", "INST]", "\n", "x"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
        assert chat.read_role(chat.write_role(text)) == text


# --- Jaccard join


def variants(seed=0, n=60):
    """Texts with copies, near copies of every degree, chains and shared passages."""
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(n)]
    out = []
    for words in base:
        for _ in range(rng.randint(1, 5)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 10_000)}"
            out.append((rng.choice([" ", "\n", "\t "])).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out


@pytest.mark.parametrize("words, num, block", [(3, 90, 256), (5, 80, 3), (1, 50, 7)])
def test_join_equals_brute_force(spark, odd, none, words, num, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "REMEMBERED", 5)
    rng = random.Random(5)
    texts = [(i, t) for i, t in enumerate([*variants(), *[" ".join(["big"] * 3 + [f"q{j % 40 if j != k else j + 1000}" for j in range(200)]) for k in range(60)], *ODD, *ODD])]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n int, component_id string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in rows(jaccard.near_duplicates(df, words, num, 100))}
    assert got == brute.components(texts, words, num, 100)
    out = rows(jaccard.near_duplicates(odd, words, num))
    assert len(out) == odd.count() and {r[2] for r in out if r[0] is None} == {None} and [r[2] for r in out if r[0] == 10] == [4]
    assert jaccard.near_duplicates(none, words, num).count() == 0


def test_join_equals_sql(spark, sf, duck):
    same_as_sql(queries.op9_ngram_jaccard_join(spark, sf), duck.sql(queries.OP9_SQL))


def test_ids_with_several_texts_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    assert {r[2] for r in rows(jaccard.near_duplicates(df, 3, 90))} == {1}


def test_keep_one(spark):
    long_ = " ".join(f"a{i}" for i in range(50))
    df = spark.createDataFrame([(4, long_, "s"), (2, long_ + " x", "t"), (2, long_ + " x", "t"), (2, "z", "a"), (2, None, "a"), (2, long_ + " x", "z"), (7, "else", "u"), (8, None, "v"), (None, long_, "w")], "doc_id long, text string, source string")
    kept = jaccard.keep_one(df)
    assert sorted(rows(kept), key=repr) == sorted([(2, long_ + " x", "t"), (7, "else", "u"), (8, None, "v"), (None, long_, "w")], key=repr)
    clash = jaccard.keep_one(df.withColumns({"_version0": F.lit(5), "_version": F.lit(6)}))
    assert {r[3:] for r in rows(clash)} == {(5, 6)} and clash.columns == [*df.columns, "_version0", "_version"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(3, 2), (2, 1), (9, 9)]
    got = dict(rows(components.connected(spark.createDataFrame(edges, "a long, b long"))))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 700)} == {500} and got[3] == got[1] == 1 and 9 not in got


def test_shingles_equal_words():
    texts = [t or "" for t in ODD] + ["A b C d", "a B c D", "a b c  d\n", "Éa b c"]
    got = list(shingles.shingle_sets(pa.array(texts), 3))
    want = [brute.shingles(t, 3) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    assert all((want[i] == want[j]) == (got[i].tolist() == got[j].tolist()) for i in range(len(texts)) for j in range(len(texts)))


# --- main text


PAGE = """<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var x="</p><article>"</script></head><body><div id=top class="site-menu"><a href=/>Home {i}</a></div><div class="promo-box">Buy &amp; save</div>
<header>Head</header><article class="post"><h1>Title {i}</h1><p>Text&nbsp;one <b>bold</b>
 {i} &lt;tag&gt; &eacute;<p>Shared passage on every page.</p><ul><li>a<li>b</ul><aside>Side</aside><div class="share">Share!</div><form><input>Send</form><section id="comments"><article class="comment"><p>Nice</p></article></section></article>
<div>Site notice: plain box without a name</div><footer>Foot</footer></body></html>"""


def test_main_text(spark, none):
    rows_ = [(i, f"http://h.org/{i}", PAGE.format(i=i)) for i in range(30)] + [(100 + i, "http://bare.org/", f"<body><div>Plain box {i // 2 * 0}</div><div>Body {i}</div></body>") for i in range(30)]
    odd = [(200, None, None), (201, "u", ""), (202, "u", "just text < 5 &amp; more"), (203, "u", "<p>open <p>next<div>deep" + "<div>" * 3000 + "x"), (204, "u", "<!-- <p>no</p> --><p>yes</p><script>no")]
    df = spark.createDataFrame([(*r, "t") for r in rows_ + odd + odd[2:3]], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in pages.extract_pages(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(30):
        assert got[i] == [f"Title {i}\nText one bold {i} <tag> é\nShared passage on every page.\na\nb"]
        assert got[100 + i] == [f"Body {i}"]  # the box recurs on the host's pages, so it is template
    assert got[200] == got[201] == [""] and got[202] == ["just text < 5 & more"] * 2 and got[203] == ["open\nnext\ndeep\nx"] and got[204] == ["yes"]
    assert pages.extract_pages(df.limit(0)).count() == 0


WRAPPED = "<body><div>Site box</div><div class=wrap><article><h1>Story {n}</h1><div><p>Body of the story.<p>More.</div><div>Get our app</div></article></div><p>fetched {i}</p></body>"


def test_copies_are_one_page(spark):
    rows_ = [(i, "http://w.org/", WRAPPED.format(n=0, i=i)) for i in range(50)]
    rows_ += [(100 + i, "http://p.org/", "<body><div><p>One.<p>Two.</div></body>") for i in range(50)]
    rows_ += [(200 + i, "http://q.org/", WRAPPED.format(n=i, i=0)) for i in range(50)]  # other titles over the same passage: different pages
    rows_ += [(300 + i, "http://r.org/", f"<body><article><div>The whole text of it {i // 50}</div><b>{i}</b></article></body>") for i in range(50)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows_, "page_id long, url string, html string")).collect()}
    for i in range(50):
        assert got[i] == "Story 0\nBody of the story.\nMore.\nGet our app"  # one page alone shows no template
        assert got[100 + i] == "One.\nTwo."
        assert got[200 + i] == f"Story {i}\nBody of the story.\nMore."
        assert got[300 + i] == f"The whole text of it 0\n{i}"


def test_main_text_of_pages(spark, sf):
    for page_id, url, text, n, *_ in rows(queries.op10_main_text(spark, sf)):
        source = spark_html(spark, sf)[page_id]
        inside = re.search(r"<article>(.*)</article>", source, re.DOTALL)[1]
        want = "\n".join(filter(None, (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inside))))
        assert text == want and n == len(want)


def test_counts_carry_the_text_of_nameless_markup(spark):
    """Neither article nor telling names: only what recurs on the host, as it stands or by shape, shows the template."""
    page = "<body><div class=x1><ul><li>Go {a}</ul></div><div>Same box</div><div class=x2>Story {i} told at some length, in words of its own, on {i} and {j}.</div><div class=x3>Seen {i} times by {j}</div><div class=x4>{k}</div></body>"
    make = lambda host, n, start: [(start + i, f"http://{host}/{i}", page.format(i=i, j=7 * i, a="<li>Go ".join(map(str, range(i % 4 + 1))), k="" if i % 3 else f"Note {i}")) for i in range(n)]
    df = spark.createDataFrame(make("many.org", 40, 0) + make("few.org", 5, 100), "page_id long, url string, html string")
    found = {r["page_id"]: r for r in pages.extract_pages(df).collect()}
    for i in range(40):
        note = [] if i % 3 else [f"Note {i}"]  # on a third of the pages: no template
        assert found[i]["text"].split("\n") == [f"Story {i} told at some length, in words of its own, on {i} and {7 * i}.", *note]
        assert found[i]["template_chars"] > 20 and found[i]["markup_chars"] == 0
    for i in range(5):  # too few pages to count: nothing goes
        text = found[100 + i]["text"]
        assert "Same box" in text and f"Seen {i} times" in text and text.startswith("Go 0")


def test_counts_carry_the_given_pages(spark, sf):
    """Without the frame and names: counted templates leave the contract's text on nearly all pages of hosts with enough pages."""
    path = sf.replace("0.001", "0.1")
    df = spark.read.parquet(f"{path}/pages.parquet").withColumn("host", F.lower(F.regexp_extract("url", pages.HOST, 1)))
    hosts = collections.defaultdict(set)
    for host, hash_ in rows(pages.site_templates(df).select("host", "hash")):
        hosts[host].add(hash_)
    some = [r for r in df.where(F.col("host").isin(*hosts)).select("host", "html").limit(400).collect()]
    same = bare = 0
    for host, source in some:
        root, inside = pages.parse(source), re.search(r"<article>(.*)</article>", source, re.DOTALL)[1]
        want = pages.text_of(pages.parse(inside), set())
        same += pages.text_of(root, hosts[host], frame=False) == want
        bare += pages.text_of(root, set(), frame=False) == want
        assert pages.text_of(root, hosts[host]) == want
    assert len(some) > 100 and same >= 0.95 * len(some) and bare < 0.05 * len(some)


def test_hashes_are_counted_by_host(spark):
    """Counts of subtrees against a plain count over different pages."""
    rows_ = [(i, f"http://h{i % 2}.org/", f"<body><div>Box {i % 3 if i % 2 else 0}</div><ul><li>L</ul><p>Page {i}</p></body>") for i in range(60)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").withColumn("host", F.regexp_extract("url", pages.HOST, 1))
    got = set(map(tuple, rows(pages.site_templates(df, min_pages=5, min_share=0.5).select("host", "hash").where("hash is not null"))))
    seen, total, shapes = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for i, url, source in rows_:
        root, host = pages.parse(source), url[7:-1]
        total[host] += 1
        found = [e for e in pages.elements(root) if pages.candidate(e)]
        seen.update({(host, e.hash) for e in found})
        shaped = collections.defaultdict(float)
        for e in found:
            if pages.shaped(e):
                shaped[e.shape] += e.shown / root.shown
        for k, v in shaped.items():
            shapes[host, k].append(v)
    want = {(h, pages.signed(k)) for (h, k), n in seen.items() if n >= max(5, 0.5 * total[h])}
    want |= {(h, pages.signed(k)) for (h, k), v in shapes.items() if len(v) >= max(5, 0.9 * total[h]) and sum(v) / len(v) <= 0.2}
    assert got == want and len(want) >= 3


def test_text_changes_with_the_templates(spark):
    html = WRAPPED.format(n=3, i=4)
    root = pages.parse(html)
    box = next(e for e in pages.elements(root) if e.tag == "div" and not e.name)
    assert pages.text_of(root, set()) == "Story 3\nBody of the story.\nMore.\nGet our app" and pages.candidate(box)
    app = next(e for e in pages.elements(root) if e.size == len("Get our app"))
    assert pages.text_of(root, {pages.signed(app.hash)}) == "Story 3\nBody of the story.\nMore."


def test_very_long_and_broken_pages(spark):
    html = "<div>" * 2000 + "<p>word &amp; " * 20_000 + "</span>" * 50 + "<article"
    df = spark.createDataFrame([(1, "http://h.org", html), (2, "http://h.org", "<" * 1000), (3, None, "<p class=\"a>x</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(df).collect()}
    assert got[1].startswith("word &\nword &") and got[1].count("\n") >= 19_998


_html = {}


def spark_html(spark, sf):
    if not _html:
        _html.update(dict(rows(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"))))
    return _html
