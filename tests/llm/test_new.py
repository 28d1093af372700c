"""Quality trees, whitening and phrase mining against plain Python, numpy, SQL and held-out labels."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import boosting, chat, decontam, document_stats, mixing, phrases, quality, whitening, word_arrays

DATA = "/root/testdata/sf0.01"
TEXTS = [None, "", " \t\n", "One word", "a b c. a b c! A b c; a b", "É çà û 日本 x\x1cy", "x" * 5000, "la la la la la\nla la la\n\nla la la", "| a | b |\n| a | b |\nDone."]


def plain_statistics(text):
    """Some of the statistics in plain Python."""
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", raw) if w]
    lines = [x for x in re.split(rb"[\n\r\x0b\x0c]+", raw) if x]
    pairs = list(zip(words, words[1:]))
    return {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "log_lines": np.log1p(len(lines)), "share_upper": sum(65 <= b <= 90 for b in raw) / max(1, len(raw)),
        "word_mean": np.mean([len(w) for w in words] or [0]), "word_sd": np.std([len(w) for w in words] or [0]), "distinct_words": len(set(words)) / max(1, len(words)), "top_word": max(Counter(words).values(), default=0) / max(1, len(words)),
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "stopped_lines": sum(x[-1:] in b".!?" for x in lines) / max(1, len(lines)), "repeated_pairs": 1 - len(set(pairs)) / len(pairs) if pairs else 0,
        "marked_words": sum(any(c in b"#*$%&|<>@^~_=+\\/" for c in w) for w in words) / max(1, len(words)), "upper_words": sum(all(65 <= c <= 90 for c in w) for w in words) / max(1, len(words)),
    }


def test_statistics_are_those_of_plain_python():
    rows = document_stats.statistics(pa.array(TEXTS))
    assert rows.shape == (len(TEXTS), len(document_stats.NAMES)) and np.isfinite(rows).all() and not rows[:2].any()
    for text, row in zip(TEXTS, rows):
        for name, value in plain_statistics(text).items():
            assert row[document_stats.NAMES.index(name)] == pytest.approx(value, abs=1e-6), (text, name)
    sliced = document_stats.statistics(pa.array(TEXTS)[4:7])
    assert np.allclose(sliced, rows[4:7]) and document_stats.statistics(pa.array([], pa.string())).shape[0] == 0


def test_flat_trees_walk_like_one_row_at_a_time():
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(600, 6)), 1)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    model = boosting.fit_trees(rows, labels, trees=40)

    def walk(row):
        total = model.start
        for feature, edge, leaf in zip(model.feature, model.edge, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > edge[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(model.log_odds(rows), [walk(r) for r in rows])
    assert ((model.probability(rows) > 0.5) == (labels > 0.5)).mean() > 0.97
    assert boosting.fit_trees(rows[:0], labels[:0]).probability(rows).tolist() == [0.5] * 600
    assert boosting.fit_trees(rows, np.ones(600)).probability(rows).min() > 0.99
    assert len(model.log_odds(rows[:0])) == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = boosting.score_quality(docs, boosting.fit_quality(docs, labels)).join(labels, "doc_id").where(boosting.fold(F.col("doc_id")) == 1)
    got = scored.select("quality_score", "quality").toPandas()
    told, good = got.quality_score >= 0.5, got.quality == 1
    assert len(got) > 1000 and told[good].mean() > 0.98 and (~told[~good]).mean() > 0.95


def test_quality_edge_cases(spark):
    rows = [(i if i else None, t, "clash", 0.5) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string, quality_score double").repartition(3)
    labels = spark.createDataFrame([(i, i % 2 if i % 5 else None) for i in range(27)] + [(None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    model = boosting.fit_quality(docs, labels, sample_rows=10)
    got = boosting.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "rank", "quality_score"] and got.count() == len(rows)
    by_text = got.groupBy("text").agg(F.countDistinct("quality_score").alias("n")).collect()
    assert {r.n for r in by_text} == {1} and 0 <= got.agg(F.min("quality_score")).first()[0]
    assert {r.quality_score for r in boosting.score_quality(docs, boosting.fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert boosting.score_quality(docs.limit(0), model).count() == 0


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], c @ u[:, ::-1]


def test_whitening_against_numpy(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").repartition(5)
    got = whitening.whiten(df).toPandas()
    given = df.toPandas()
    x, n, s, e, y = plain_whitening(list(given.embedding))
    at = got.pivot(index="vec_id", columns="component", values="whitened").loc[given.vec_id].to_numpy()
    assert np.allclose(np.abs(at), np.abs(y[:, :8] / np.sqrt(e[:8])), atol=1e-9)
    signs = np.sign(at * y[:, :8])
    assert (signs == signs[0]).all()  # one sign a component for all rows
    want = dict(zip(given.vec_id, (((n * x - s).astype(object)) ** 2).sum(1)))
    assert {r.vec_id: r.deviation for r in got.itertuples()} == want and set(got.n) == {n}
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx(e[:8] / e.sum(), rel=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_edge_cases(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (None, [2.0, 1.0]), (5, [1.0]), (6, []), (7, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, n int, x string").repartition(4)
    got = whitening.whiten(df).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter({(4, 1): 2, (4, 2): 2, (None, 1): 1, (None, 2): 1, (7, 1): 1, (7, 2): 1})
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-9
    x, n, s, e, _ = plain_whitening([[1, 2], [1, 2], [2, 1], [0.5, 0.25]])
    assert sorted({(r.component, round(r.explained, 9)) for r in got}) == [(1, round(e[0] / e.sum(), 9)), (2, round(e[1] / e.sum(), 9))]
    assert whitening.whiten(df.limit(0)).collect() == []
    same = whitening.whiten(df.where("vec_id = 4")).collect()  # no variance at all
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in same] == [(0.0, 0.0, 0, 0.0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")).toPandas()
    assert line[line.component > 1].whitened.eq(0).all() and line[line.component == 1].whitened.std(ddof=0) == pytest.approx(1) and line.identity_error.max() < 1e-9


def plain_phrases(rows, least, keep):
    """The contract in plain Python."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = Counter({k: v for k, v in f.items() if v >= least})
    out = []
    for lang in n:
        found = []
        for p, a in f.items():
            if p[0] == lang and len(p) > 2:
                w = p[1:]
                longer = [b for q, b in f.items() if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q)))]
                if not any(100 * b >= 80 * a for b in longer):
                    score, _, l, r = min((2_000_000 * a // (f[p[: k + 1]] + f[(lang, *w[k:])]), k, f[p[: k + 1]], f[(lang, *w[k:])]) for k in range(1, len(w)))
                    found.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:keep])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(df, **args):
    return sorted(map(tuple, phrases.collocations(df, **args).select(*COLUMNS).collect()))


def test_phrases_against_plain_python(spark):
    rng = np.random.default_rng(5)
    words = np.array(["a", "B", "cc", "d\x1c", "é", "日", "E", "the"])
    texts = [("".join(w + s for w, s in zip(rng.choice(words, 60, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.1]), rng.choice([" ", "  ", "\t", ", ", "\n", "!"], 60, p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05])))) for _ in range(60)]
    rows = [("en" if i % 3 else None if i % 2 else "und", t) for i, t in enumerate(texts)] + [("fr", None), ("fr", ""), ("en", " . , "), ("en", texts[1]), ("en", texts[1]), ("de", "x" * 3000 + " " + "y z " * 500), ("", "q q q q q q")]
    df = spark.createDataFrame([(i, *r, "und", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, k int").repartition(4)
    for least, keep in ((5, 2000), (3, 7)):
        assert mined(df, least=least, keep=keep) == plain_phrases(rows, least, keep)
    assert phrases.collocations(df.limit(0)).count() == 0
    first = phrases.collocations(df, least=5).where("lang = 'de'").first()
    at = re.sub(" +", " ", rows[first.doc_id][1].encode()[first.byte :].decode())
    assert at.startswith(first.phrase)


def test_phrases_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(phrases.SQL).fetchall()
    assert mined(spark.read.parquet(f"{DATA}/documents.parquet")) == sorted(want) and len(want) > 100


def test_phrases_of_equal_fingerprints_stay_apart():
    batch = pa.record_batch({"text": ["aa bb aa cc", "bb aa dd ee"], "lang": ["en", "en"]})
    words = phrases.Words(batch)
    text = [words.raw[a:b].tobytes() for a, b in zip(words.starts, words.stops)]
    words.hashes[:] = [t in (b"bb", b"ee") for t in text]  # five words, two fingerprints
    number = phrases.exact_words(words)
    assert all((number[i] == number[j]) == (text[i] == text[j]) for i in range(8) for j in range(8))
    everything = lambda fps: np.ones(len(fps), bool)
    got = Counter({tuple(text[at : at + n]): f for n, places, counts in phrases.phrases_of(words, everything) for at, f in zip(places.tolist(), counts.tolist())})
    want = Counter(tuple(t[i : i + n]) for t in (text[:4], text[4:]) for n in range(1, 5) for i in range(len(t) - n + 1))
    assert got == want


def test_fingerprints_don_t_depend_on_windows(monkeypatch):
    raw = np.frombuffer(b"one two three one two three four " * 40, np.uint8)
    starts, stops = word_arrays.runs(raw != 32, np.array([0, len(raw)]))
    whole = word_arrays.byte_hashes(raw, starts, stops)
    monkeypatch.setattr(word_arrays, "WINDOW", 16)
    assert (word_arrays.byte_hashes(raw, starts, stops) == whole).all()
    assert (word_arrays.sequence_hashes(whole, 3)[:7] == word_arrays.sequence_hashes(whole[:9], 3)).all()
    assert len({int(x) for x in whole}) == 4


def expected_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, total = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(want.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return want | {s: level * weight[s] for s in left}
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    return want


def words(n, tag="w"):
    return " ".join([tag] * n)


def test_mix_shares_ties_to_the_word(spark):
    rows = [(None, "a", words(1)) for _ in range(300)] + [(None, "a", words(2)) for _ in range(100)] + [(7, "b", words(5)) for _ in range(200)] + [(i, "c", words(3, str(i))) for i in range(900)] + [(1, None, None), (None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = expected_targets(sizes)
    for whole, most in ((False, 1), (True, 3)):
        got, taken = mixing.mix(docs, whole=whole).collect(), Counter()
        for r in got:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r["size"] and r.target == pytest.approx(want[r.source])
        assert all(abs(taken[s] - want[s]) <= most for s in sizes), (taken, want)
        again = mixing.mix(docs.repartition(3), whole=whole).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    out, by_source = mixing.mixed_documents(docs).collect(), Counter()
    for r in out:
        by_source[r.source] += len((r.text or "").split())
    assert all(abs(by_source[s] - want[s]) <= 3 for s in sizes) and all(r.text for r in out)


def test_mixed_documents_by_row_and_with_any_names(spark):
    rows = [(5, "A", words(8), 1, "x", 0.5, 9, 8, 7), (5, "B", words(6), 2, "y", 0.5, 9, 8, 7), (5, "C", None, 3, "z", 0.5, 9, 8, 7), (None, "B", words(4, "q"), None, None, None, None, None, None), (None, "B", words(4, "r"), 1, "n", 0.1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int, mix_id string, mix_copy double, bad_id long, bad_row long, n long")
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    copies = Counter(tuple(r) for r in got.collect())
    assert set(copies) <= set(rows) and rows[2] not in copies and max(copies.values()) <= 2
    want = expected_targets(Counter({"A": 8, "B": 14, "C": 0}))
    assert abs(8 * copies[rows[0]] - want["A"]) <= 4 and abs(sum(len(r[2].split()) * n for r, n in copies.items() if r[1] == "B") - want["B"]) <= 3
    items = spark.createDataFrame([(1, words(6))], "item_id long, text string")
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.text is None or not r.text.startswith("w"))


def test_pipeline_stages_with_odd_rows_and_names(spark):
    sf = "/root/testdata/sf0.001"
    odd = [(None, None, None, None, 0), (None, "", "en", "a", 0), (3, words(40, "same"), "en", "a", 1), (3, words(40, "same"), "en", "a", 1), (3, words(30, "other"), "de", None, 2), (None, words(50_000, "long"), "en", "b", 3), (4, " \n\t", "en", "b", 4)]
    names = "toxicity_of_row copies mix_id mix_copy bad_id bad_row doc component fp n id row no_id".split()
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
        if name != "token_ids":
            assert out.columns == docs.columns, name
            kept = out.collect()
            given = Counter(map(str, docs.collect()))
            assert set(map(str, kept)) <= set(given), name  # rows come out as they were
            if name in ("toxicity", "benchmark_decontamination"):
                assert Counter(str(r) for r in kept if r.doc_id in (None, 3, 4)) == Counter(k for r in docs.collect() if r.doc_id in (None, 3, 4) for k in [str(r)]), name
        else:
            assert out.count() == docs.count() and out.agg(F.sum("n_tokens")).first()[0] > docs.count()


def prose(i, n=150):
    return " ".join(f"w{(i * 37 + k * k) % 991} river" for k in range(n // 2))


def judged(spark, rows):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    return {r.doc_id for r in quality.judge_quality(docs).where("NOT kept AND NOT base_failed").collect()}


def test_quality_keeps_clean_groups(spark):
    clean = [(prose(i) + (" 5% & 3%" if i % 40 == 0 else ""), "en", f"s{i % 3}") for i in range(1500)]
    assert judged(spark, clean) == set()  # some symbols in some documents of equal prose are no junk
    tailing = [(prose(i) + " %" * (i % 120), "en", "s") for i in range(1500)]
    assert len(judged(spark, tailing)) <= 15  # a bulk that tails off isn't cut through
    lines = [("\n".join([prose(i, 12)] * (1 + i % 2) + [prose(i * 50 + k, 12) for k in range(14)]), "de", "s") for i in range(400)]
    assert judged(spark, lines) == set()


def test_quality_finds_what_stands_apart(spark):
    rows = [(prose(i) if i % 20 else " ".join(w + "###" for w in prose(i).split()), "en", f"s{i % 7}") for i in range(1400)]
    assert judged(spark, rows) == {i for i in range(1400) if i % 20 == 0}
    small = [*rows[1:700], (rows[0][0], "en", "rare"), (prose(3), "en", "rare"), (rows[0][0], None, None)]  # a source and a language of a few documents
    at = {i for i, r in enumerate(small) if "###" in r[0]}
    assert judged(spark, small) == at
    long_words = [(" ".join("x" * (9 if i else 60) for _ in range(50)) + f" {i}", "en", "s") for i in range(200)]
    assert judged(spark, long_words) <= {0}


def test_quality_limits_are_averages_by_size(spark):
    rows = [(prose(i, 100 if i < 600 else 600), "en", "short" if i < 600 else "long") for i in range(1200)] + [(prose(i, 600), "en", "few") for i in range(5)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.source: r for r in quality.fences(quality.sketch(quality.steps(quality.measure(docs)))).collect()}
    assert got["short"].symbols_high > 3 * got["long"].symbols_high  # less can hide in a long document
    assert got["long"].symbols_high < got["few"].symbols_high < got["short"].symbols_high


def test_long_records_parse_or_raise(spark, monkeypatch):
    monkeypatch.setattr(chat, "LONG_RECORD", 40)
    fine = spark.createDataFrame([(1, '{"role": "user", "text": "%s"}' % ("x" * 50)), (2, "no json"), (3, None)], "conv_id long, record string")
    assert [r.layout is not None for r in chat.canonical_turns(fine).orderBy("conv_id").collect()] == [True, False, False]
    with pytest.raises(Exception, match="MALFORMED_RECORD|parse"):
        chat.canonical_turns(spark.createDataFrame([(1, "x" * 50)], "conv_id long, record string")).collect()


def test_index_blocks_end_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b c " * (1 if i else 3000)) for i in range(40)] + [(99, None)], "doc_id long, text string").coalesce(1)
    index = decontam.build_index(docs)
    assert index.count() == 1
    items = spark.createDataFrame([(1, "b c a0 b"), (2, "a7 b c")], "item_id long, text string")
    want = sorted(map(str, decontam.search_items(index, items).select("doc_id", "n_words", "spans", "items").collect()))
    rows = pa.record_batch({"text": [r.text for r in docs.collect()]})
    assert [b.num_rows for b in word_arrays.by_bytes([rows], most=1000)] == [1, 40]
    assert len(want) == 41 and sum("items=['1']" in w for w in want) == 1
