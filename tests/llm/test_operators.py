"""The text operators against plain versions of what they compute."""

import datetime
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
import tiktoken
from odd import DOCS, LONG, rows_of, written
from pyspark.sql import functions as F

import corpus_pipeline
from sagitta.llm import bpe, common, fingerprint, langid, lm, mixing, neardup, ogg, pii, quality, registry, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(common.WORD_PATTERN)


def table(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").df()


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# common


def test_words_and_shingles():
    texts = ["", "  a bb\tccc", "x", "Ünï cödé a b c d", "\n", "a bb"]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s, e, first = common.word_spans(data, offs)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == [w for t in texts for w in WORD.findall(t)]
    assert np.diff(first).tolist() == [len(WORD.findall(t)) for t in texts]
    h = common.word_hashes(data, s, e)
    assert len(set(h.tolist())) == len({w for t in texts for w in WORD.findall(t)})
    g, at = common.shingle_hashes(h, first)
    assert np.diff(at).tolist() == [0, 1, 1, 2, 0, 1]


# 1


def shingle_set(text):
    w = low(text).split() if not re.search("[\x1c-\x1f\x85\xa0]", text) else WORD.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_against_sets(spark):
    got = fingerprint.query(spark, SF).toPandas().sort_values("doc_id")
    texts = table("documents").sort_values("doc_id").text.tolist()
    errors = []
    for t, n, r in zip(texts, texts[1:] + texts[:1], got.itertuples(), strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (n, r.near_next)):
            a, b = shingle_set(t), shingle_set(other)
            errors.append(abs(len(a & b) / len(a | b) - near))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2
    by_text = defaultdict(set)
    for t, f in zip(texts, got.fingerprint, strict=True):
        by_text[t].add(f)
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprint_neighbours(spark, tmp_path, monkeypatch):
    plain_ranges = fingerprint.ranges
    ids = [5, 3, 9, 3, None, 7]
    sf = written(spark, tmp_path, [(i, f"text {k} of {i}", "en", "s") for k, i in enumerate(ids)])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = fingerprint.neighbours(docs, {"text": F.col("text")})
    after = {r.text: r.next_text for r in got.collect()}
    order = ["text 4 of None"]
    while len(order) < 6:
        order.append(after[order[-1]])
    assert [t.rsplit(" ", 1)[1] for t in order] == ["None", "3", "3", "5", "7", "9"] and after[order[-1]] == order[0]
    one = docs.where("doc_id = 9")
    assert fingerprint.neighbours(one, {"text": F.col("text")}).first().next_text == "text 2 of 9"
    hot = [(i, f"text {k}") for k, i in enumerate([None] * 60 + [7] * 40 + list(range(20)))]
    rows = spark.createDataFrame(hot, "doc_id long, text string").repartition(7)
    for size in (5, 1000):
        monkeypatch.setattr(fingerprint, "ranges", lambda d, k, t, f=plain_ranges, n=size: f(d, k, t, n))
        after = {r.text: r.next_text for r in fingerprint.neighbours(rows, {"text": F.col("text")}).collect()}
        order = [f"text {0}"]
        while len(order) < len(hot):
            order.append(after[order[-1]])
        ids = [dict((t, i) for i, t in hot)[t] for t in order]
        start = ids.index(None) if ids[0] is not None else next(k for k in range(len(ids)) if ids[k - 1] is not None and ids[k] is None)
        turned = ids[start:] + ids[:start]
        assert sorted(order) == sorted(t for _, t in hot) and [i if i is not None else -1 for i in turned] == sorted(i if i is not None else -1 for i, _ in hot)
    bounds = list(range(0, 3000, 3))
    assert [r[0] for r in spark.range(0, 3000, 7).select(fingerprint.range_of(F.col("id"), bounds)).collect()] == [i // 3 for i in range(0, 3000, 7)]


def test_fingerprint_of_no_words(spark):
    rows = spark.createDataFrame([("",), ("  ",), (None,), ("a",), ("a b",)], "t string").select(fingerprint.fingerprint(F.col("t")).alias("f")).collect()
    assert [len(r.f) for r in rows] == [0, 0, 0, 256, 256]
    near = spark.createDataFrame([("", ""), ("", rows[3].f), (rows[3].f, rows[3].f), (rows[3].f, rows[4].f)], "a string, b string").select(fingerprint.likeness(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in near][:3] == [1, 0, 1] and near[3].n < 0.15


# 2


def plain_segments(scores):
    """Maximal scoring segments by their definition: the best one, then those to its left and right."""
    def best(a, b):
        found = [(round(sum(scores[i:j]), 9), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(found, default=(0, 0, 0, 0))
        if top[0] <= 0:
            return []
        _, _, i, j = top
        return [*best(a, i), (i, j - 1, top[0]), *best(j, b)]

    return best(0, len(scores))


def test_segments_against_definition():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 14)
        hits = sorted(rng.sample(range(n), rng.randrange(0, n + 1)))
        w = [rng.choice([0.53, 1.07, 2.11]) for _ in hits]
        scores = [-0.37] * n
        for p, x in zip(hits, w, strict=True):
            scores[p] = x
        got = toxicity.segments(hits, w, -0.37)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in plain_segments(scores)]


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.query(spark, "/root/testdata/sf0.1").toPandas().merge(table("labels", "/root/testdata/sf0.1"), on="doc_id").merge(table("documents", "/root/testdata/sf0.1")[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    english = held[held.lang == "en"]
    assert ((english.predicted == 1) & (english.toxic == 1)).sum() >= 0.85 * english.toxic.sum()
    assert ((held.predicted == 1) & (held.toxic == 0)).mean() < 0.005
    assert got.score.between(0, 1).all()


def test_toxicity_finds_toxic_rows_of_every_language(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).toPandas().merge(table("labels", sf), on="doc_id").merge(table("documents", sf)[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    toxic = held[held.toxic == 1]
    assert set(toxic.lang) == {"de", "en", "es", "fr"}
    assert (toxic.groupby("lang").predicted.mean() >= 0.85).all()
    assert ((held.predicted == 1) & (held.toxic == 0)).mean() < 0.005


def test_rare_tokens_without_clean_rows_are_told(spark):
    # 12 of 352 toxic documents and no clean one have token 1; token 2 is as common in both kinds
    rows = [(1, 12, 0), (2, 20, 160), (3, 320, 2640)]
    found, n1, n0 = toxicity.standing_out(spark.createDataFrame(rows, "token long, toxic long, clean long"))
    assert [r.token for r in found] == [1] and (n1, n0) == (352, 2800) and toxicity.lexicon(found, n1, n0, 3.0).weights[0] > 1


def test_lexicon_and_statistic_against_plain_ones(spark):
    """Counts, log-odds, standing out and the statistic of every text, from their definitions."""
    rng = random.Random(6)
    common_, vile = [f"word{chr(97 + k)}" for k in range(20)], ["vilex", "viley"]
    texts = [(i, " ".join([*rng.choices(common_, k=30), *(rng.choices(vile, k=2) if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(120)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    found, n1, n0 = toxicity.standing_out(toxicity.token_counts(rows))
    counts = defaultdict(lambda: [0, 0])
    for _, t, y in texts:
        for w in set(t.split()):
            counts[w][y] += 1
    assert (n1, n0) == tuple(sum(c[y] for c in counts.values()) for y in (1, 0))
    plain = {}
    for w, (clean, toxic) in counts.items():
        prior, whole = 0.02 * (clean + toxic), 0.02 * (n1 + n0)
        odds = math.log((toxic + prior) / (n1 + whole - toxic - prior)) - math.log((clean + prior) / (n0 + whole - clean - prior))
        term = lambda k, n: k * math.log(k * (n1 + n0) / ((clean + toxic) * n)) if k else 0.0  # noqa: B023, E731
        z = math.copysign(math.sqrt(max(0.0, 2 * (term(toxic, n1) + term(clean, n0)))), odds)
        if toxic >= 3 and z >= 2 and odds >= 1:
            plain[w] = odds
    assert set(plain) == set(vile)
    hashes = {int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]): w for w in counts}
    assert {hashes[r.token % 2**64]: round(r.odds, 9) for r in found} == {w: round(v, 9) for w, v in plain.items()}
    model = toxicity.lexicon(found, n1, n0, 2.0)
    in1, in0 = (sum(counts[w][y] for w in vile) for y in (1, 0))
    assert model.gap == pytest.approx(math.log((1 - (in1 + 0.5) / (n1 + 1)) / (1 - (in0 + 0.5) / (n0 + 1))))
    model.constant, model.base, model.slope = 1e-4, -3.0, 2.0
    for r in toxicity.scored(rows, model).collect():
        words = dict((i, t) for i, t, _ in texts)[r.doc_id].split()
        best = plain_segments([plain.get(w, model.gap) for w in words])
        expected = -sum(x for x in (math.log(1e-4 * len(words)) - v for *_, v in best) if x < math.log(toxicity.CHANCE))
        assert r.statistic == pytest.approx(expected, abs=1e-6) and r.score == pytest.approx(1 / (1 + math.exp(3 - 2 * math.log1p(expected))), abs=1e-6)


def test_samples_are_bounded_and_cover_long_texts(spark):
    rows = spark.createDataFrame([(1, f"text {i % 7}", "en") for i in range(3000)] + [(i, "x", "de") for i in range(40)] + [(None, None, None)], "doc_id long, text string, lang string")
    got = {r.lang: r["count"] for r in common.bounded_sample(rows, 100, "lang").groupBy("lang").count().collect()}
    assert got["en"] <= 100 and got["de"] == 40 and common.bounded_sample(rows, 100).count() <= 100
    assert [r.lang for r in common.bounded_sample(rows, 100, "lang", groups=1).select("lang").distinct().collect()] == ["en"]
    text = "".join(chr(97 + i // 1000) for i in range(20_000))
    short = spark.createDataFrame([("ab",), (text,)], "t string").select(common.excerpt(F.col("t"))).collect()
    assert short[0][0] == "ab" and {"a", "t", "j"} <= set(short[1][0]) and len(short[1][0]) == 5 * 1600 + 4


def test_long_texts_teach_languages_and_quality(spark, tmp_path):
    rng = random.Random(2)
    words = {"de": ["der", "nicht", "und", "schön"], "en": ["the", "with", "that", "nice"]}
    rows = [(i, " ".join(rng.choices(words[k], k=9000 if k == "de" else 40)), k, "s") for i, k in enumerate(["de", "en"] * 40)]
    sf = written(spark, tmp_path, rows)
    got = langid.query(spark, sf).toPandas().merge(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet/*.parquet'").df(), on="doc_id")
    assert (got.lang_pred == got.lang).all()
    junk = [(100 + i, "$$ || ## " * 4000, "en", "s") for i in range(40)]
    sf = written(spark, tmp_path / "junk", [(r[0], ". ".join(r[1].split()), *r[2:]) for r in rows if r[2] == "de"] + junk)
    assert quality.query(spark, sf).toPandas().score.std() > 0.01


def test_toxic_passages_are_spans(spark):
    token = common.word_hashes(np.frombuffer(b"vile", np.uint8), np.array([0]), np.array([4]))
    model = toxicity.Model(token, np.array([5.0]), -0.01, 1e-4, 2.0, -3.0)
    text = "Größe äöü ok. VILE vile ok " + "fine " * 2000 + "vile end"
    got = toxicity.scored(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [text[p.start : p.stop] for p in got[0].passages] == ["VILE vile", "vile"] and got[1].passages == [] and got[0].score > got[1].score


# 3


def test_mix_meets_targets(spark):
    got = mixing.query(spark, SF).toPandas().merge(table("documents")[["doc_id", "source", "text"]], on="doc_id")
    assert (got["size"] == got.text.map(lambda t: len(WORD.findall(t)))).all()
    size = got.groupby("source")["size"].sum()
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(size.index))}
    left, target = float(size.sum()), {}
    while True:
        share = {s: left * w / sum(w for x, w in weight.items() if x not in target) for s, w in weight.items() if s not in target}
        full = [s for s in share if share[s] > 3 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
    for s, rows in got.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(target[s])
        assert abs(rows.taken.sum() - target[s]) <= 1.5 * rows["size"].max()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = mixing.query(spark, SF).toPandas()
    assert got[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_mix_stops_at_the_limit(spark, tmp_path):
    sf = written(spark, tmp_path, [(1, "w " * 10, "en", "a"), (2, "w " * 990, "en", "b"), (3, "w " * 1, "en", None), (4, "w " * 1, "en", "zz")])
    got = {r.doc_id: r for r in mixing.query(spark, sf).collect()}
    assert [got[i].target for i in (1, 3, 4)] == [30, 3, 3] and got[2].target == pytest.approx(1002 - 36)
    assert [got[i].taken for i in (1, 3, 4)] == [30, 3, 3]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.where("doc_id = 1").count() == 3


def test_mix_of_rows_that_share_ids(spark, monkeypatch):
    """Rows without an id, rows of one id and equal rows: emit hands out what the query takes, whatever the blocks."""
    rows = [(None, f"w{i} x y", "a") for i in range(90)] + [(7, f"z{i} " * (1 + i % 3), "b") for i in range(60)] + [(8, "same text here", "c")] * 50 + [(i, "one two " * (i % 9), "c") for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, copy long, _each string").repartition(5)
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    results = []
    for block in (mixing.BLOCK_ROWS, 7):
        monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows) and all(r.copies <= 3 for r in got)
        results.append(sorted((r.doc_id or -1, r.size, r.copies) for r in got))
    assert results[0] == results[1]
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    made = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    held = Counter(rows)
    assert all(made[k] <= 3 * held[k] for k in made)
    words = defaultdict(int)
    for (_, t, s), n in made.items():
        words[s] += n * len(t.split())
    taken = defaultdict(int)
    for r in got:
        taken[round(r.target, 6)] += r.size * r.copies
    assert sorted(words.values()) == sorted(taken.values())
    assert all(abs(n - t) <= 1.5 * 16 for t, n in taken.items()) and sum(words.values()) == pytest.approx(sum(size.values()), abs=40)


# 4


def test_languages_on_held_out_rows(spark):
    got = langid.query(spark, SF).toPandas().merge(table("documents"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()


def test_languages_without_letters_or_labels(spark, edge, tmp_path):
    got = {r.doc_id: r.lang_pred for r in langid.query(spark, edge).collect()}
    assert got[1] == got[2] == got[6] == got[9] == "und" and got[5] != "und"
    sf = written(spark, tmp_path, [(1, "some text", None, "a")])
    assert langid.query(spark, sf).first().lang_pred == "und"


def test_language_gradient_learns():
    model = langid.train(["der die das und nicht " * 5] * 30 + ["the and of that with " * 5] * 30, ["de"] * 30 + ["en"] * 30)
    raw = b"that and the"
    assert model.languages[model.probabilities(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).argmax()] == "en"


# 5


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_feistel_permutes(spark):
    for n in (1, 2, 3):
        got = [r[0] for r in spark.range(10**n).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), n, "0"), "t", "k")).collect()]
        assert sorted(got) == [f"{i:0{n}d}" for i in range(10**n)]
    days = [r[0] for r in spark.range(pii.DAYS_LEFT * pii.DAYS_RIGHT).select(pii.feistel(F.col("id"), F.lit(pii.DAYS_LEFT).cast("long"), F.lit(pii.DAYS_RIGHT).cast("long"), F.lit("d"), "k")).collect()]
    assert sorted(days) == list(range(len(days)))


def plain_feistel(value, left, right, tag):
    a, b = divmod(value, right)
    for turn in range(pii.ROUNDS):
        f = lambda x: int(hashlib.sha256(f"{pii.OPEN_KEY}:{turn}:{tag}:{x}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if turn % 2 == 0:
            a = (a + f(b)) % left
        else:
            b = (b + f(a)) % right
    return a * right + b


def test_pseudonyms_keep_formats(spark):
    keep = ["order 4111111111111112 of 1999-02-30", "v1.2.3.4.5 999.1.1.1 12345678901234567", "mean 3.14 in 2024, 000-12-3456", "x" * 50, "", None, "a@b 1-2-3 key = short"]
    hide = {
        "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005"], "date": ["2001-02-28", "28.02.2001", "1999/12/31"], "ip": ["43.21.141.162"],
        "email": ["und.34@mail7.example.com"], "phone": ["+1 (017) 555-7713", "555-123-4567"], "ssn": ["219-09-9999"], "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    }
    rows = [(i, t) for i, t in enumerate(keep)] + [(100 + k, f"so {v}, and ({v})") for k, v in enumerate(itertools.chain(*hide.values()))] + [(200, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end')]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), found="kinds").collect()}
    assert [got[i].text for i in range(len(keep))] == keep and all(got[i].kinds == [] for i in range(len(keep)))
    new = {}
    for k, (kind, v) in enumerate((kind, v) for kind, many in hide.items() for v in many):
        r = got[100 + k]
        m = re.fullmatch(r"so (.*), and \((.*)\)", r.text)
        assert m[1] == m[2] != v and r.kinds == [kind] * 2
        new[v] = m[1]
        if kind not in ("email", "ip"):
            assert re.sub("[0-9]", "9", m[1]) == re.sub("[0-9]", "9", v)
    assert luhn(new["4111111111111111"]) and new["4111 1111 1111 1111"].replace(" ", "") == new["4111111111111111"]
    assert plain_feistel(411111111111111, 10**8, 10**7, "card15") == int(new["4111111111111111"][:15])
    assert datetime.date.fromisoformat(new["2001-02-28"]) == datetime.datetime.strptime(new["28.02.2001"], "%d.%m.%Y").date()
    assert all(int(p) < 256 for p in new["43.21.141.162"].split("."))
    for v in ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"):
        flat = new[v].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert re.fullmatch(r'token = "[0-9a-z]{40}" end', got[200].text) and "04dbebab" not in got[200].text


def test_pseudonyms_leave_clean_documents(spark):
    before = table("documents").set_index("doc_id").text
    got = pii.query(spark, SF).toPandas().set_index("doc_id")
    changed = got[[c for c in got.columns if c.startswith("n_")]].sum(axis=1) > 0
    assert (got.text[~changed] == before.loc[got.index[~changed]]).all() and (got.text[changed] != before.loc[got.index[changed]]).all()
    cards = lambda texts: [m for t in texts for m in re.findall(r"(?<![\w.-])\d{16}(?![\w-]|\.\d)", t)]
    valid = {c for c in cards(before) if luhn(c)}
    assert valid and not valid & set(cards(got.text)) and {c for c in cards(before) if not luhn(c)} <= set(cards(got.text))
    mails = {m for t in before for m in re.findall(r"[\w.+-]+@[\w.-]+\w", t)}
    assert mails and not any(m in t for t in got.text for m in mails)


def test_formats_of_dates_phones_and_secrets(spark):
    import datetime

    hidden = {
        "date": ["12/25/2024", "12/15/2024", "3/4/2020", "2/29/2024", "2020-3-4", "25.12.2024", "9.10.2020"],
        "phone": ["+44 20 7946 0958", "+49 30 1234567", "+33 1 23 45 67 89", "+33.1.23.45.67.89", "+44 (20) 7946 0958"],
        "secret": ["access_token=abcdefgh12345678", "client_secret=abcdefgh12345678", "API_TOKEN: abcdefgh12345678", "my-key = abcdefgh12345678"],
    }
    kept = ["13/25/2024", "2/30/2023", "+3.14159265", "+1 2 3", "monkey=abcdefgh12345678", "1/2/3/2020x"]
    rows = [(kind, x) for kind, all_ in hidden.items() for x in all_] + [(None, x) for x in kept]
    got = {r.was: r for r in pii.pseudonymised(spark.createDataFrame([(k, x, f"on {x}, so") for k, x in rows], "kind string, was string, text string"), found="kinds").collect()}
    for kind, x in rows:
        assert got[x].kinds == ([kind] if kind else []), x
        assert (got[x].text == f"on {x}, so") == (kind is None), x
    for x in hidden["phone"]:
        assert re.sub("[0-9]", "0", got[x].text) == re.sub("[0-9]", "0", f"on {x}, so") and got[x].text.startswith(f"on {x[:3]}")
    for x in ("12/25/2024", "12/15/2024", "2/29/2024"):
        m, d, y = map(int, got[x].text[3:-4].split("/"))
        assert d > 12 and datetime.date(y, m, d)
    assert re.fullmatch("on [1-9][0-9]?/[1-9][0-9]?/[0-9]{4}, so", got["3/4/2020"].text)
    assert all(got[x].text.startswith(f"on {x[: -len('abcdefgh12345678')]}") for x in hidden["secret"])


def plain_stream(turn, tag, size, other):
    return "".join(hashlib.sha256(f"{pii.OPEN_KEY}:{turn}:{tag}:{size}:{b}:{other}".encode()).hexdigest() for b in range(max(size - 1, 0) * 4 // 64 + 1))


def plain_text(text, tag, alphabets=("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), back=False):
    """A text permuted by the network over its halves, or turned back."""
    def moved(part, stream):
        out = []
        for i, c in enumerate(part):
            a = next((a for a in alphabets if c in a), None)
            by = int(stream[4 * i : 4 * i + 4], 16)
            out.append(a[(a.index(c) + (-by if back else by)) % len(a)] if a else c)
        return "".join(out)

    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in range(pii.ROUNDS)[:: -1 if back else 1]:
        if turn % 2 == 0:
            left = moved(left, plain_stream(turn, tag, len(left), right))
        else:
            right = moved(right, plain_stream(turn, tag, len(right), left))
    return left + right


def plain_digits(digits, tag):
    n = len(digits)
    return f"{plain_feistel(int(digits), 10 ** (n - n // 2), 10 ** (n // 2), tag + str(n)):0{n}d}"


def put_digits(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def plain_new(m):
    """The pseudonym of a match of the kinds that the tables have, None where its validation fails."""
    digits = re.sub("[^0-9]", "", m)
    if lead := re.match(pii.NAME, m):
        return lead[0] + plain_text(m[lead.end() :], "secret")
    if "@" in m:
        name, domain = m.lower().split("@")
        return plain_text(name, "name") + "@" + plain_text(domain, "domain") + ".example"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        try:
            day = datetime.date.fromisoformat(m)
        except ValueError:
            return None
        return (datetime.date(1900, 1, 1) + datetime.timedelta(plain_feistel((day - datetime.date(1900, 1, 1)).days, 49, 1490, "date"))).isoformat()
    if re.fullmatch(r"\d+(\.\d+){3}", m):
        parts = [int(p) for p in m.split(".")]
        return ".".join(map(str, plain_feistel(int.from_bytes(bytes(parts), "big"), 65536, 65536, "ip").to_bytes(4, "big"))) if max(parts) < 256 else None
    if re.fullmatch(r"\d{4}([ -]?\d){9,15}", m):
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        body = plain_digits(digits[:-1], "card")
        return put_digits(m, body + next(c for c in "0123456789" if luhn(body + c)))
    if re.match(r"[+(]|\d{3}[ .-]\d{3,4}[ .-]", m):
        lead = re.match(r"(\+[0-9]{1,3}[ .(-]+)?", m)[0]
        rest = m[len(lead) :]
        return lead + put_digits(rest, plain_digits(re.sub("[^0-9]", "", rest)[:18], "phone"))
    raise AssertionError(m)


def test_pseudonyms_against_a_plain_scanner(spark):
    """Every text of the table: the same matches, by another engine, and the same values, by plain Python."""
    scan = regex.compile(pii.ANY)
    got = {r.doc_id: r for r in pii.query(spark, SF).collect()}
    changed = 0
    for r in table("documents").itertuples():
        want = scan.sub(lambda m: plain_new(m[0]) or m[0], r.text)
        assert got[r.doc_id].text == want, r.doc_id
        changed += want != r.text
    assert changed > 20


def test_pseudonyms_of_text_are_permutations(spark):
    two = [a + b for a in "0123456789" for b in "0123456789"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in two], "t string").select(pii.permuted_text(F.col("t"), "x", pii.OPEN_KEY)).collect()]
    assert sorted(got) == two
    long = ["", "a", "Ab-9", "x" * 700, "k3Y_" * 200, "été"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in long], "t string").select(pii.permuted_text(F.col("t"), "x", pii.OPEN_KEY)).collect()]
    assert got == [plain_text(t, "x") for t in long] and [plain_text(t, "x", back=True) for t in got] == long


def test_secrets_addresses_and_times(spark):
    long = "Ab3" * 200
    hidden = [
        ("secret", "token = 1234567890123456"), ("secret", "secret: 4111111111111112"), ("secret", "token=QX12ZKJ9LMNOPQRSTUV"), ("secret", 'key="+AbCdEfghijklmnopqr12"'), ("secret", f"api_key={long}"),
        ("secret", "token: eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0"), ("email", "jürgen@example.org"), ("email", "key=abcdefghijklmnop@example.org"[4:]), ("ipv6", "2001:db8::1"), ("ipv6", "fe80:0:0:0:202:b3ff:fe1e:8329"),
        ("date", "2001-02-28T10:00:00Z"), ("date", "12/31/1999"), ("date", "1/2/2003"),
    ]
    kept = ["10:00:00", "1::2", "std::vector", "key: short", "at 12:30", "a::b::c", "2001-02-30T10:00:00Z"]
    rows = [(kind, x) for kind, x in hidden] + [(None, x) for x in kept]
    got = {r.was: r for r in pii.pseudonymised(spark.createDataFrame([(k, x, f"on {x}, so") for k, x in rows], "kind string, was string, text string"), found="kinds").collect()}
    for kind, x in rows:
        assert got[x].kinds == ([kind] if kind else []), x
        assert (got[x].text == f"on {x}, so") == (kind is None), x
    assert long[-20:] not in got[f"api_key={long}"].text and len(got[f"api_key={long}"].text) == len(f"on api_key={long}, so")
    assert "jü" not in got["jürgen@example.org"].text and got["2001-02-28T10:00:00Z"].text.endswith("T10:00:00Z, so")
    other = {r.was: r.text for r in pii.pseudonymised(spark.createDataFrame([(x, x) for _, x in hidden], "was string, text string"), key="another").collect()}
    assert all(f"on {other[x]}, so" != got[x].text for _, x in hidden)
    clash = spark.createDataFrame([("x", "ann.lee@example.org")], "parts string, text string")
    assert pii.pseudonymised(clash).columns == ["parts", "text"] and pii.pseudonymised(clash).first().parts == "x"


def test_dates_with_month_first_are_permuted(spark):
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(73_049)]
    late = [f"{d:%m%d%Y}" for d in days if d.day > 12]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in late], "d string").select(pii.month_first_date(F.col("d"), "k")).collect()]
    assert sorted(got) == sorted(late)


# 6


def test_language_model_base_and_gain(spark):
    got = lm.query(spark, SF).toPandas().set_index("doc_id")
    tokens = {r.doc_id: [*WORD.findall(low(r.text)), None] for r in table("documents").itertuples()}
    counts = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.1 * held.n_tokens.sum()


def small_corpus(spark, path, n=40):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "abcdefghijkl" for b in ("x", "yy", "zzz", "w", "vu", "tsr", "q") for c in ("", "o", "no")]
    return written(spark, path, [(i, " ".join(rng.choices(words, [1 + k * k for k in range(len(words))], k=rng.randrange(0, 120))), "en", "s") for i in range(n)])


def test_language_model_is_a_distribution(spark, tmp_path):
    """After any history the probabilities of all known words and of one unseen word of each class add up to 1."""
    docs = spark.read.parquet(f"{small_corpus(spark, tmp_path)}/documents.parquet")
    counted = common.cut(lm.counts(docs), "counts")
    known = lm.vocabulary(counted)
    known.own_class, known.named = known.own_class[:150], 150  # so that there are rare words
    full = {r.token % 2**64: (r.n, r.ending) for r in counted.collect()}
    rank = dict(zip(known.head.tolist(), known.rank.tolist(), strict=True))
    known.places = np.ones(lm.CLASSES)
    for h, (n, ending) in full.items():
        if rank[h] >= 150:
            known.places[lm.SINGLE + lm.FREQUENCY + ending % lm.ENDING] += n + 1
    model = lm.train(docs, known)
    assert np.abs(model.before).max() > 0.01 and np.abs(model.weights).max() > 0.01
    for f, one, two in (((5, 3, 7), 2, 9), ((known.named, known.named, 11), lm.CLASSES, lm.CLASSES), ((70, 1, 900), 70, 3)):
        rows = np.array([[f[0]], [known.context + f[1]], [2 * known.context + f[2]]])
        shares = np.exp(lm.log_shares(model.weights, model.bias, rows))[0]
        total = 0.0
        for h, (n, ending) in full.items():
            r, e = np.array([rank[h]]), np.array([ending])
            c = known.classes(r, e)
            word = np.exp(model.word_logs(known, r, c, np.array([[one], [two]])))[0] if c[0] < lm.SINGLE + lm.FREQUENCY else (n + 1) / known.places[c[0]]
            total += shares[c[0]] * word
        # one unseen word of each class of rare ones; classes that no word is in have what is left
        rare = np.arange(lm.SINGLE + lm.FREQUENCY, lm.CLASSES)
        total += (shares[rare] / known.places[rare]).sum()
        held = {int(known.classes(np.array([rank[h]]), np.array([e]))[0]) for h, (_, e) in full.items()} | set(rare.tolist())
        assert total == pytest.approx(sum(shares[c] for c in held), abs=1e-5) and shares.sum() == pytest.approx(1, abs=1e-5)


def plain_scores(texts, learn, known, rounds):
    """The model of a small table from its definition: dictionaries, one token at a time, no batches. Ranks and classes are given."""
    h_of = lambda w: int(common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    rank = dict(zip(known.head.tolist(), known.rank.tolist(), strict=True))
    docs = {}
    for i, t in texts.items():
        h, ending, _ = lm.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        assert h.tolist() == [*(h_of(w) for w in WORD.findall(low(t))), int(lm.END)]
        docs[i] = [(rank.get(x, -1), int(e)) for x, e in zip(h.tolist(), ending.tolist(), strict=True)]
    cls = lambda r, e: int(known.own_class[r]) if 0 <= r < len(known.own_class) else lm.SINGLE + lm.FREQUENCY + e % lm.ENDING
    own = lambda r, e: r if 0 <= r < known.named else known.named + 1 + e % lm.ENDINGS

    def events(i):
        d = docs[i]
        for k, (r, e) in enumerate(d):
            one, two = (own(*d[k - j]) if k >= j else known.named for j in (1, 2))
            pair = int(common.mixed(np.array([one * known.context + two], np.uint64))[0] % np.uint64(known.pairs))
            yield r, e, cls(r, e), (one, known.context + two, 2 * known.context + pair), tuple(cls(*d[k - j]) if k >= j else lm.CLASSES for j in (1, 2))

    seen, one, two, both = Counter(), Counter(), Counter(), Counter()
    for i in learn:
        for r, _, c, f, k in events(i):
            seen.update((x, c) for x in f)
            if lm.SINGLE <= c < lm.SINGLE + lm.FREQUENCY:
                one[r, k[0]] += 1
                two[r, k[1]] += 1
                both[c, *k] += 1
    count = {r: n + 1.0 for r, n in zip(known.rank.tolist(), known.count.tolist(), strict=True)}
    mass = np.ones(lm.CLASSES)
    for r, n in count.items():
        if r < len(known.own_class):
            mass[known.own_class[r]] += n
    mass[lm.SINGLE + lm.FREQUENCY :] = known.places[lm.SINGLE + lm.FREQUENCY :]
    share = mass / mass.sum()
    a, b = defaultdict(float), defaultdict(float)
    members = defaultdict(list)
    for r in range(lm.SINGLE, len(known.own_class)):
        members[int(known.own_class[r])].append(r)
    word = lambda r, k: count[r] * math.exp(a[r, k[0]] + b[r, k[1]])
    for _ in range(lm.WORD_TURNS):
        expected_one, expected_two = Counter(), Counter()
        for (c, *k), n in both.items():
            z = sum(word(r, k) for r in members[c])
            for r in members[c]:
                expected_one[r, k[0]] += n * word(r, k) / z
                expected_two[r, k[1]] += n * word(r, k) / z
        for r in range(lm.SINGLE, len(known.own_class)):
            for k in range(lm.PLACES):
                a[r, k] += 0.5 * math.log((one[r, k] + lm.WORD_PRIOR) / (expected_one[r, k] + lm.WORD_PRIOR))
                b[r, k] += 0.5 * math.log((two[r, k] + lm.WORD_PRIOR) / (expected_two[r, k] + lm.WORD_PRIOR))
    weights, rows = {}, {x for i in texts for *_, f, _ in events(i) for x in f}
    totals = Counter()
    for (x, _), n in seen.items():
        totals[x] += n
    observed = {x: np.array([seen[x, c] for c in range(lm.CLASSES)], float) for x in rows}
    for x in rows:
        kind = lm.START_WEIGHTS[0 if x < known.context else 1 if x < 2 * known.context else 2]
        weights[x] = kind * np.log((observed[x] + lm.PRIOR * share) / ((totals[x] + lm.PRIOR) * share))
    logs = lambda f: (lambda z: z - np.log(np.exp(z).sum()))(np.log(share) + sum(weights[x] for x in f))
    for turn in range(lm.ROUNDS):
        g = defaultdict(lambda: np.zeros(lm.CLASSES))
        for i in learn:
            if rounds[i] == turn:
                for _, _, c, f, _ in events(i):
                    p = np.exp(logs(f))
                    p[c] -= 1
                    for x in f:
                        g[x] += p
        for x, total in g.items():
            weights[x] = weights[x] - np.clip(lm.RATE * total / ((observed[x] + lm.PRIOR * share) / lm.ROUNDS + lm.LEAST), -1, 1)
    out = {}
    for i in texts:
        score = 0.0
        for r, _, c, f, k in events(i):
            score += logs(f)[c]
            if lm.SINGLE <= c < lm.SINGLE + lm.FREQUENCY:
                score += math.log(word(r, k) / sum(word(x, k) for x in members[c]))
            elif c >= lm.SINGLE + lm.FREQUENCY:
                score += math.log(count.get(r, 1.0) / known.places[c])
        out[i] = score / math.log(10)
    return out


def test_language_model_against_a_plain_one(spark, tmp_path):
    docs = spark.read.parquet(f"{small_corpus(spark, tmp_path, 25)}/documents.parquet").select("doc_id", "text")
    learnable = F.col("doc_id") % 5 != 0
    turns = {r.doc_id: r.turn for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("round"), "doc_id", "text"), F.lit(lm.ROUNDS)).alias("turn")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in lm.scored(docs, learnable).collect()}
    known = lm.vocabulary(common.cut(lm.counts(docs.where(learnable)), "counts"))
    want = plain_scores(texts, [i for i in texts if i % 5], known, turns)
    assert got == {i: pytest.approx(x, rel=1e-5, abs=1e-5) for i, x in want.items()}


def test_language_model_does_not_depend_on_the_split(spark):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    learnable = F.col("doc_id") % 7 != 2
    scores = [{r.doc_id: r.score for r in lm.scored(docs.repartition(n, "doc_id"), learnable).collect()} for n in (2, 40)]
    assert scores[0] == {i: pytest.approx(x, rel=1e-6) for i, x in scores[1].items()}


def test_rare_words_are_joined(spark):
    """A head of a few words gives the same base scores as one that holds all."""
    docs = common.read(spark, SF, "documents").limit(200)
    counted = common.cut(lm.counts(docs), "counts")
    scores = []
    for head in (50, 1 << 20):
        known = lm.vocabulary(counted, head)
        scores.append({r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs, counted, known, lm.flat(known)).collect()})
    assert scores[0] == scores[1]


# 7


def crc_bit_by_bit(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_ogg_round_trips():
    rng = random.Random(3)
    for n, streams, packet in itertools.product((0, 1, 191, 192, 4000, 65_025, 200_000), (1, 2, 3), (255, 1000, 255 * 300)):
        payload = ogg.padded(rng.randbytes(n))
        assert len(payload) % 192 == 0 and len(payload) >= max(192, n)
        back, told = ogg.samples(ogg.mux(payload, streams=streams, packet=packet))
        assert back == payload and told["streams"] == streams and told["seconds"] == len(payload) / ogg.RATE
    assert ogg.page_checksum(b"123456789") == crc_bit_by_bit(b"123456789")


def test_ogg_errors():
    media = bytearray(ogg.mux(ogg.padded(b"x" * 9000)))
    for at in (0, 30, 300, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.demux(bytes(broken))
    with pytest.raises(ValueError):
        ogg.demux(bytes(media[:-5]))
    found = ogg.demux(bytes(media))["streams"]
    assert len(found) == 2 and all(s["granules"][0] == 0 for s in found.values())


def test_ogg_lacing_of_whole_segments():
    """A packet of a multiple of 255 bytes ends with a lacing value of 0; one over a page's end goes on in the next."""
    media = ogg.mux(b"a" * (255 * 255 * 2), streams=1, packet=255 * 255 * 2)
    (s,) = ogg.demux(media)["streams"].values()
    assert [len(p) for p in s["packets"]] == [len(ogg.HEADER) + 12, 255 * 255 * 2]


def test_ogg_columns(spark):
    got = ogg.query(spark, SF).toPandas().merge(table("documents"), on="doc_id")
    for r in got.itertuples():
        raw = r.text.encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    files = spark.createDataFrame([(1, ogg.mux(ogg.padded(b"abc"))), (2, b"zz"), (3, None)], "doc_id long, media binary")
    rows = ogg.decode(files).collect()
    assert [r.doc_id for r in rows if r.error] == [2, 3] and {r.serial for r in rows if r.doc_id == 1} == {0x5A670000, 0x5A670001}
    assert struct.unpack_from("<I", next(r.packet for r in rows if r.packet), len(ogg.HEADER))[0] == ogg.RATE


# 8


def plain_classes(texts):
    sets = {i: shingle_set(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        common_ = len(sets[a] & sets[b])
        if common_ and 100 * common_ >= 75 * (len(sets[a]) + len(sets[b]) - common_):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_against_brute_force(spark, tmp_path):
    """Groups of all sorts: copies, near copies at every distance, chains, and a passage that unlike documents share."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, i = {}, 0
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = word()
        texts[i], i = " ".join(w), i + 1
        texts[i], i = " ".join([*passage, *(word() for _ in range(rng.randrange(20, 80)))]), i + 1
        if k % 10 == 0:
            texts[i], i = texts[i - 1].upper(), i + 1
    chain = [word() for _ in range(60)]
    for _ in range(20):
        chain = chain[1:] + [word()]
        texts[i], i = " ".join(chain), i + 1
    for t in ("", None, "a b", "A  b", "a b c d e", " "):
        texts[i], i = t, i + 1
    sf = written(spark, tmp_path, [(k, t, "en", "s") for k, t in texts.items()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.query(spark, sf).collect()}
    assert got == plain_classes(texts)


def test_rows_without_id_link_and_bridge(spark):
    words = [f"w{i}" for i in range(100)]
    ends = [" ".join(words), " ".join(words[8:] + [f"x{i}" for i in range(8)]), " ".join(words[16:] + [f"x{i}" for i in range(16)])]
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(1, ends[0]), (None, ends[1]), (2, ends[2]), (3, other), (None, other + " end")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 96): 1, (None, 96): 1, (2, 96): 1, (3, 56): 3, (None, 57): 3}


def test_buckets_of_several_parts_are_compared_across(spark, tmp_path):
    """Without any round of leaders all links come from the comparison across parts."""
    texts = {r.doc_id: r.text for r in table("documents", "/root/testdata/sf0.001").itertuples()}
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs, rounds=0).collect()}
    assert got == plain_classes(texts)


def test_block_pairs_meet_every_pair_once(spark):
    rows = [(b, node, 0) for b, n in ((1, 1), (2, 7), (3, 23)) for node in range(100 * b, 100 * b + n)]
    u, v = neardup.block_pairs(spark.createDataFrame(rows, "bucket long, node long, part long"), 5)
    met = Counter()
    for r in u.join(v, ["bucket", "i", "j"]).collect():
        if r.i != r.j or r.u_node < r.v_node:
            met[min(r.u_node, r.v_node), max(r.u_node, r.v_node)] += 1
    assert met == Counter(p for b, n in ((1, 1), (2, 7), (3, 23)) for p in itertools.combinations(range(100 * b, 100 * b + n), 2))


def test_large_buckets_are_split(spark, monkeypatch):
    """Unlike documents that share most of their text, and copies of some: in small blocks, without rounds of leaders."""
    monkeypatch.setattr(neardup, "block_pairs", lambda live, f=neardup.block_pairs: f(live, 8))
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = {i: " ".join([*passage, *(f"{'abcd'[i % 4]}{rng.randrange(10**6)}" for _ in range(rng.randrange(10, 40)))]) for i in range(120)}
    texts |= {200 + i: texts[i] + " end" for i in range(0, 120, 9)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs, rounds=0).collect()} == plain_classes(texts)


def test_survivors(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " x"), (5, "other words that nobody has at all"), (5, "other words that nobody has at all"), (7, base.replace("w", "v")), (7, base.replace("w", "v") + " y"), (None, ""), (8, "")]
    got = neardup.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.rows, r.kept) for r in got) == [(0, 1, False), (0, 1, True), (0, 1, True), (5, 2, True), (7, 1, False), (7, 1, True), (8, 1, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i != 25] + [(100, 3), (200, 201), (201, 202), (200, 202), (5, 5)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 26)} == {0} and {got[i] for i in range(27, 51)} == {26} and got[100] == 0 and got[202] == 200


def test_near_dedup_spares_the_driver(spark):
    """Sizes are counted while tables are written, not by queries of their own, and what the driver sends is bounded in bytes."""
    texts = [" ".join(f"w{i}x{k + j}" for k in range(60)) for i in range(40) for j in range(0, 8, 2)] + ["", None, "a b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsCount()
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    bus.waitUntilEmpty()
    classes = plain_classes(dict(enumerate(texts)))
    assert left == {i for i, (_, c) in classes.items() if c == i}
    assert store.executionsCount() - before <= 28  # 36 with queries for counts
    # 252 bytes: a leader with its sketch, in the table that the driver builds
    assert neardup.BROADCAST_ROWS * 252 <= 32 << 20
    hinted = lambda n: "broadcast" in neardup.sent(spark.range(3), n)._jdf.queryExecution().logical().toString()
    assert hinted(100_000) and not hinted(166_172)


def test_shuffles_give_the_same_as_broadcasts(spark, monkeypatch):
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(docs).collect()}
    assert got == plain_classes({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})


def test_counted(spark):
    frame, n, most = common.counted(spark.range(10).where("id > 3"), "some", F.max("id"))
    assert (n, most, frame.count()) == (6, 9, 6)
    none = spark.range(10).where("id > 30").groupBy("id").count().join(spark.range(5), "id")
    frame, n, most = common.counted(none, "none", F.max("id"))
    assert (n, most, frame.count()) == (0, None, 0)
    empty, n = common.counted(spark.createDataFrame([], "a long"), "empty")
    assert n == 0 and empty.columns == ["a"]


def test_pipeline_reads_what_only_spark_opens(spark, tmp_path):
    texts = [(i, " ".join(f"w{i // 2}x{k}" for k in range(40)) + " end" * (i % 2), "en", "ab"[i % 2]) for i in range(20)]
    sf = written(spark, tmp_path, texts, [(i, 1, i % 2) for i in range(20)])
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{sf}")
    left = lambda path: sorted(corpus_pipeline.run(spark, path).select("doc_id", "ids_sha256").collect())
    assert left("viewfs://store/in") == left(sf)


def test_odd_sketch_estimates():
    """The bits in which sketches differ follow the similarity, and the screen lets pass what is similar enough."""
    rng = np.random.default_rng(0)
    for j in (0.75, 0.8, 0.9, 0.97):
        passed = 0
        for _ in range(40):
            n = 400
            shared = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
            _, s = neardup.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            passed += int(np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum()) <= neardup.screen_bits()
        assert passed == 40


# 9


def test_em_recovers_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.8
    right = np.array([0.9, 0.8, 0.95, 0.7])
    v = np.where(rng.random((len(y), 4)) < right, y[:, None], ~y[:, None]).astype(int)
    v[rng.random(v.shape) < 0.3] = 2
    found, count = np.unique(quality.pattern(v), return_counts=True)
    post, shares, prior = quality.accuracies(found, count, 4)
    assert prior == pytest.approx(0.8, abs=0.02)
    assert shares[1, :, 1] / (1 - shares[1, :, 2]) == pytest.approx(right, abs=0.02)
    assert ((post[np.searchsorted(found, quality.pattern(v))] > 0.5) == y).mean() > 0.93


def test_quality_against_labels(spark):
    got = quality.query(spark, "/root/testdata/sf0.1").toPandas().merge(table("labels", "/root/testdata/sf0.1"), on="doc_id")
    assert ((got.predicted == 0) & (got.quality == 0)).sum() >= 0.97 * (got.quality == 0).sum()
    assert ((got.predicted == 0) & (got.quality == 1)).sum() <= 0.03 * (got.quality == 1).sum()


# 10


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    ranks = {w: i for i, w in enumerate(bpe.read_ranks(bpe.vocabulary_path()))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, reference):
    got = bpe.query(spark, SF).toPandas().merge(table("documents"), on="doc_id")
    for r in got.itertuples():
        ids = reference.encode_ordinary(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_bpe_on_odd_texts(spark, reference):
    import public_tokenizers as P

    codec = bpe.codec(bpe.vocabulary_path(), P.PATTERN)
    for t in ("", "   \n\t x", "a" * 5000, "日本語テキスト🎉\x00▁▁ <unk>", "x’s it's 12345 ###$$$", " " * 3000, LONG[:20_000], "", "<|endoftext|>"):
        assert codec.encode(t) == reference.encode_ordinary(t) and codec.decode(codec.encode(t)) == t.encode()
    docs = spark.createDataFrame(rows_of([(1, "héllo wörld", "en", "a"), (2, None, "en", "a")]), DOCS)
    back = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [r.text for r in back] == ["héllo wörld", ""] and back[0].score == 1.5


def test_registry_names():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11))
