"""Each operator against brute force, round trips or held-out accuracy, with nulls, empties, ties and odd columns."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import chat, decontam, line_join, mixing, near_copies, quality, set_join, simhash, suffix_dedup, token_store, toxicity, urls
from vitrine.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor %d sit amet\n"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank. it was fun!", "en", "a"), (2, "The quick brown fox jumps over the lazy dog near the river bank. it was fun!", "en", "a"),
    (3, None, "en", None), (4, "", None, "b"), (5, "   \n\t ", "en", "b"), (6, "solo", "en", "b"), (7, "two words", "fr", "c"), (8, "".join(LONG % i for i in range(3000)), "en", "a"),
    (9, "É çà û ñ – 日本語 ١٢ text\x1cwith\x85odd\u2028spaces <|endoftext|> İstanbul ΑΣ", "fr", "c"), (10, "a b c d e f g h a b c d e f g h a b c d e f g h", "en", "c"), (10, "a b c d e f g h a b c d e f g h a b c d e f g h", "en", "c"),
    (None, "null id text here", "en", "a"), (11, "x" * 500, "en", "a"), (12, "y" + "x" * 300 + "z", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, 0, "clash", 1.5) for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, taken double").repartition(3)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_toxicity_held_out_accuracy(spark, sample):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit_toxicity(sample, labels)
    rows = toxicity.score_toxicity(sample, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("toxicity.score", "toxic").collect()
    told, toxic = np.array([r.score >= 0.5 for r in rows]), np.array([bool(r.toxic) for r in rows])
    assert (told == toxic).mean() > (1 + (~toxic).mean()) / 2  # half of the way from a constant to perfect at least
    # recall and precision on the larger tables, where the labels are many enough to learn from
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = scored.select("toxicity.score", "toxic").collect()
    told, toxic = np.array([r.score >= 0.5 for r in rows]), np.array([bool(r.toxic) for r in rows])
    assert told[toxic].mean() > 0.8 and toxic[told].mean() > 0.9 and (told == toxic).mean() > 0.97


def test_toxicity_goes_on_after_a_text_without_room(spark):
    rows = [(i, "all is well. you vile thing here!" if i % 2 else "all is well. good day.", i % 2) for i in range(60)]
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(100 + k, 1) for k in range(3)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100 + k, "very long " * 4000) for k in range(3)], "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, labels, sample_chars=30_000)
    assert np.count_nonzero(model.weights) and toxicity.Scorer(model)("all is well. you vile thing here!")[0] > 0.5


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's texts don't come to the driver; the model is that of the same rows fitted here."""
    rows = [(i, "all is well. you vile thing here!" if i % 2 else "all is well. good day.", i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    rank = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    kept = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(rank, "doc_id").collect()
    want = toxicity.fit_bags(*toxicity.bags_of([r.text for r in kept], [r.toxic for r in kept]))
    driver, own = os.getpid(), toxicity.bags_of
    monkeypatch.setattr(toxicity, "bags_of", lambda *a: pytest.fail("fitted on the driver") if os.getpid() == driver else own(*a))
    got = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert np.count_nonzero(want.weights) and (got.weights == want.weights).all() and got.bias == want.bias


def test_toxicity_locates_sentences_and_edge_cases(spark, docs):
    bags = toxicity.bags_of(["all is well. you vile thing here!", "all is well. good day."] * 30, [1, 0] * 30)
    model = toxicity.fit_bags(*bags)
    df = spark.createDataFrame([(1, "all is well. you vile thing here! good day."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(df, model).collect()}
    text = "all is well. you vile thing here! good day."
    assert got[1].score > 0.5 and [text[s.start : s.stop] for s in got[1].offending] == ["you vile thing here!"]
    assert got[2].score == got[3].score == 0.0
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_token_store_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 50)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    path = token_store.new_store_path(spark)
    token_store.write_store(docs, path, tokenizer_path(), 1, tasks=3)
    got = sorted((r.key is not None, r.key or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, path).collect())
    at, want = 0, []
    for i, t, *_ in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i is not None, i or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    monkeypatch.setattr(token_store, "INDEX_KEYS", 3)
    for asked, most in (([10, 7, 99, None, 7], 10_000), (list(range(-5, 40)), 10_000), ([8, 10, 1], 0)):
        monkeypatch.setattr(token_store, "MOST_BROADCAST", most)
        got = token_store.lookup(spark, path, spark.createDataFrame([(k,) for k in asked], "key long")).collect()
        want = [(i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in TEXTS if i in asked]
        assert sorted(((r.key, r.ids) for r in got), key=str) == sorted(want, key=str)
        assert {(r.key, r.nth) for r in got if r.key == 10} == ({(10, 1), (10, 2)} if 10 in asked else set())
    empty = token_store.new_store_path(spark)
    token_store.write_store(docs.limit(0), empty, tokenizer_path(), 1)
    assert token_store.read_store(spark, empty).count() == 0
    assert token_store.lookup(spark, empty, spark.createDataFrame([(1,)], "key long")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    enc = token_store.Encoder(tokenizer_path(name))
    assert enc.apart == (name == "word_bpe_49k.json")
    rng = np.random.default_rng(3)
    letters = "abcXYZ éÀ'sßüñ0123²¼_-.,!?%&<|>\n\t\x0b\x1c\x1f\x85\xa0İŁɏαΣς́中ªº µ'tre'll'd´`×÷"
    for _ in range(1500 if enc.apart else 100):
        text = "".join(rng.choice(list(letters), rng.integers(0, 30)))
        assert np.frombuffer(enc(text), enc.dtype).tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_minimal_perfect_hash():
    for n in (1, 2, 5, 1000):
        keys = np.random.default_rng(n).integers(-(2**62), 2**62, n)
        assert sorted(token_store.build_mph(np.unique(keys))[1].tolist()) == list(range(n))


def slow_simhash(text):
    from xxhash import xxh64_intdigest

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_classes_equal_brute_force(spark, sample, docs):
    rows = sample.select("doc_id", "text").collect()
    fps = {r.doc_id: slow_simhash(r.text) for r in rows[:200]} | {r.doc_id: simhash.simhash(r.text) for r in rows[200:]}
    up = {i: i for i in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(sample).collect()}
    assert got == {i: (fps[i], top(i)) for i in fps}
    odd = simhash.near_duplicates(docs).collect()
    assert len(odd) == len(TEXTS) and {r.component for r in odd if r.doc_id in (3, 4, 5)} == {3} and {r.component for r in odd if r.doc_id is None} == {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9, 10, 11, 12] and kept.columns == docs.columns


def test_vantage_point_tree_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "LEAF", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))
    dense = np.uint64(12345) ^ rng.integers(0, 256, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, near, dense]))
    nodes = spark.createDataFrame([(int(f.astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, id long")
    roots = {r.id: r.root for r in simhash.components(simhash.link_fingerprints(nodes)).collect()}
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            forest.join(i, i + 1 + int(j))
    assert all(roots.get(i, i) == forest.top(i) for i in range(len(fps)))


def test_chat_round_trip_and_layouts(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b <|end|>\n <\\| [\\INST] \\<|", "", None, "<<SYS>> <|turn|> [[INST]", "\\", "<\\", "é\n日"]
    rows = [(i // 3, i % 3, "assistant" if i % 2 else "us<|er", t, "x") for i, t in enumerate(texts)] + [(None, None, None, "n", "x"), (5, 1, "user", "t", "x"), (5, 1, "user", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(df).withColumn("turns", chat.parse_chat(F.col("formatted")))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    for conv in {r[0] for r in rows}:
        assert got[conv] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] or 0)]
    digest = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(df)).collect()}
    loss = "".join(r[3] or "" for r in rows if r[0] == 0 and r[2] == "assistant")
    assert digest[0].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[0].loss_chars == len(loss)
    assert chat.format_chats(df.limit(0)).count() == 0
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","input":"","output":"a"}',
        '{"prompt":"q","response":"a"}', '{"question":"q","answer":"a"}', '{"role":"user","text":null}', '{"other":1}', "not json", None, '{"instruction":"q","input":"i","output":"a"}',
    ]
    got = {r.record: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "record string")).collect()}
    pair = [("user", "q"), ("assistant", "a")]
    beside = ['{"id":7,"messages":[{"name":"n","role":"user","content":"q"},{"name":"n","role":"assistant","content":"a"}],"source":"s"}', '{"lang":"en","prompt":"q","response":"a"}', '{"id":{"deep":1},"prompt":"q","response":"a"}']
    odd = spark.createDataFrame([(r, 1, "mine") for r in beside], "record string, v int, shape string")
    rows = {r.record: r for r in chat.canonical_turns(odd).collect()}
    assert [[tuple(x) for x in rows[r].turns] for r in beside] == [pair, pair, []] and all((r.v, r["shape"]) == (1, "mine") for r in rows.values())
    assert [got[r][1] == pair for r in records[:5]] == [True] * 5 and [got[r][0] for r in records[:3]] == ["messages", "from_value", "instruction_input"]
    assert got[records[5]] == ("turn_rows", [("user", None)]) and [got[r] for r in records[6:9]] == [(None, [])] * 3 and got[records[9]][1][0] == ("user", "q\n\ni")


def test_url_rules_and_terms(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://a.net": ("a.net", "", None, "allow"), "https://Sub.Example.NET/en/1?q#f": ("sub.example.net", "/en/1", "example.net/en/", "allow"),
        "http://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"), "x://spam-farm.com/": ("spam-farm.com", "/", None, "block"), "x://a.com/cheap": ("a.com", "/cheap", None, "allow"), "x://a.com/cheap/cheap": ("a.com", "/cheap/cheap", None, "allow"),
        "x://a.com/cheap_pills": ("a.com", "/cheap_pills", None, "block"), "x://a.com/cheapest/pills2": ("a.com", "/cheapest/pills2", None, "allow"), None: ("", "", None, "allow"), "nothing": ("", "", None, "allow"), "porn": ("", "", None, "block"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    rows = urls.judge_urls(df.union(df)).collect()
    assert {r.url: tuple(r.judged)[:4] for r in rows} == cases and len(rows) == 2 * len(cases) and {r.host for r in rows} == {"h"}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_large_weighted_vocabulary(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcdef"), rng.integers(3, 7))) for _ in range(5000)})
    terms = [(w, bool(i % 50 == 0), float(i % 3) / 2 if i % 7 else None) for i, w in enumerate(words)] + [(None, True, 1.0), ("", True, 1.0), (words[1].upper(), False, 0.1)]
    vocabulary = urls.read_vocabulary(spark.createDataFrame(terms, "term string, strict boolean, weight double"))
    strict, weight = {w for w, s, _ in terms if s and w}, {w: 1.0 if x is None else x for w, _, x in terms[: len(words)]}
    made = ["x://h/" + "/".join(rng.choice(words + ["plain", "zzz9"], rng.integers(0, 4))) for _ in range(300)] + ["x://h/" + "q" * 200_000 + "/" + words[0]]
    df = spark.createDataFrame([(u, "mine") for u in made], "url string, hits string")
    with pytest.raises(ValueError, match="at most"):
        urls.read_vocabulary(spark.createDataFrame(terms, "term string, strict boolean, weight double"), most=10)
    for r in urls.judge_urls(df, vocabulary=vocabulary, soft_limit=1.0).collect():
        found = set(re.findall(r"[a-z0-9]+", r.url))
        soft = [weight[w] for w in found & weight.keys() - strict]
        assert r.judged.verdict == ("block" if found & strict or len(soft) >= 2 and sum(soft) >= 1.0 else "allow") and r.hits == "mine"


def slow_contamination(texts, items, window=13):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = {}
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_equals_brute_force(spark, sample, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    own = [(1, "Quick brown fox"), (2, None), (3, "..."), (4, "solo"), (None, "solo"), (5, " ".join("abcdefgh" * 3)), (5, "TWO-words"), (6, LONG % 7 * 40)]
    for d, items, groups in ((sample, [(r.item_id, r.text) for r in bench.collect()], (1 << 18, 700)), (docs, own, (1 << 18, 3))):
        rows = d.select("doc_id", "text").collect()
        want = sorted(zip([r.doc_id or -1 for r in rows], slow_contamination([r.text for r in rows], [("" if i is None else str(i), t) for i, t in items]), strict=True))
        table = spark.createDataFrame(items, "item_id long, text string")
        for most in groups:
            got = decontam.judge_contamination(decontam.find_items(d, table, group_phrases=most)).drop("row_key").collect()
            assert sorted((r.doc_id or -1, tuple(r)[1:]) for r in got) == want
    assert decontam.find_items(docs.limit(0), bench).count() == 0
    assert decontam.find_items(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontam.drop_contaminated(docs, bench.limit(0)).columns == docs.columns and decontam.drop_contaminated(docs, bench.limit(0)).count() == len(TEXTS)


def slow_proximity(words, phrase, slop):
    """All places where every word of the phrase stands within slop of its own."""
    near = lambda p, k: any(0 <= q < len(words) and words[q] == phrase[k] for q in range(p + k - slop, p + k + slop + 1))
    return [p for p in range(-slop - len(phrase), len(words) + slop) if all(near(p, k) for k in range(len(phrase)))]


def test_proximity_matches_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    texts = ["alpha beta gamma", "alpha x beta x gamma", "gamma x x x x alpha beta", "alpha", "", None, *[" ".join(rng.choice(["alpha", "beta", "gamma", "x", "y"], rng.integers(1, 14))) for _ in range(90)]]
    phrases = ["alpha beta gamma", "gamma x", "y", "beta beta alpha y"]
    items = spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string")
    for parts, slop in ((1, 1), (3, 0), (7, 1), (7, 2)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        got = {r.doc_id: (r["items"], {i for s in r.spans for i in range(s.start, s.stop)}) for r in decontam.find_items(docs, items, slop=slop).collect()}
        for i, t in enumerate(texts):
            words, own, hit = (t or "").split(), [], set()
            for n, phrase in enumerate(phrases):
                places = slow_proximity(words, phrase.split(), slop)
                own += [str(n)] if places else []
                hit |= {w for p in places for w in range(max(0, p), min(len(words), p + len(phrase.split())))}
            assert got[i] == (own, hit), (slop, t)


def test_one_index_serves_any_benchmark(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (2, "two three")], "doc_id long, text string")
    index = decontam.build_index(docs)
    for phrase, want in (("two three", [1, 2, 2]), ("three four", [1]), ("four five", [])):
        found = decontam.search_items(index, spark.createDataFrame([(9, phrase)], "item_id long, text string"))
        assert sorted(r.doc_id for r in found.where("size(items) > 0").collect()) == want


def test_mixing_budgets(spark, sample, docs):
    for d in (sample, docs):
        rows = mixing.mix(d).collect()
        assert len(rows) == d.count()
        sizes, taken, target = Counter(), Counter(), {}
        for r in rows:
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r["size"]
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        want, left, total = {}, set(names), 1.5 * sum(sizes.values())
        while left:
            level = (total - sum(want.values())) / sum(weight[s] for s in left)
            full = {s for s in left if level * weight[s] >= 2 * sizes[s]}
            if not full:
                want |= {s: level * weight[s] for s in left}
                break
            want |= {s: 2.0 * sizes[s] for s in full}
            left -= full
        assert target == pytest.approx(want) and all(sizes[s] == r.source_size for s in names for r in rows if r.source == s)
        assert all(abs(taken[s] - target[s]) <= 3 for s in names)
        assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, rows))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_repeated_strings_equal_brute_force(spark, docs, sample):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeé"), 6)) for _ in range(40)]
    passage = " ".join(rng.choice(words, 60))
    made = [(i, " ".join(rng.choice(words, 20)) + passage[rng.integers(0, 80) : rng.integers(200, 400)] + " ".join(rng.choice(words, 30))) for i in range(40)]
    made += [(100, "ab" * 300), (101, "ab" * 150 + "c"), (102, "xx" + "ab" * 120), (103, None), (104, ""), (105, "q" * 200), (106, "q" * 201), (107, made[0][1]), (107, made[0][1])]
    for d, texts in ((spark.createDataFrame(made, "doc_id long, text string"), made), (docs, [t[:2] for t in TEXTS])):
        raw = [(t or "").encode() for _, t in texts]
        spans = suffix_dedup.brute_force(raw, 200)
        want = sorted((i or -1, len(t), sum(b - a for a, b in s), len(s), h) for (i, _), t, s, h in zip(texts, raw, spans, suffix_dedup.sha256_of(raw, spans), strict=True))
        for hot in (4096, 2):
            got = suffix_dedup.digest_removals(suffix_dedup.remove_repeats(d, hot=hot)).collect()
            assert sorted((r.doc_id or -1, *tuple(r)[1:]) for r in got) == want
        groups = {}
        for r in suffix_dedup.repeat_groups(d).collect():
            groups.setdefault(r.repeat, set()).add((r.doc_id, r.start, r.stop))
        by_id = {i: (t or "").encode() for i, t in texts}
        covered = {i: np.zeros(len(t), bool) for i, t in by_id.items()}
        for found in groups.values():
            strings = {by_id[i][a:b] for i, a, b in found}
            assert len(strings) == 1 and len(found) > (107 not in {i for i, _, _ in found})
            (w,) = strings
            assert len(w) >= 200 and found == {(i, a, a + len(w)) for i, t in by_id.items() for a in range(len(t)) if t.startswith(w, a)}  # all occurrences
            for i, a, b in found:
                covered[i][a:b] = True
        once = suffix_dedup.brute_force(raw, 200)
        for (i, _), own in zip(texts, once, strict=True):
            assert covered[i].sum() == sum(b - a for a, b in own)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_dedup.repeat_groups(docs.limit(0)).count() == 0


def test_maximal_repeats_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        both = {("".join(rng.choice(list("ab"), rng.integers(0, 6))).encode(), b"X" + "".join(rng.choice(list("ab"), rng.integers(0, 6))).encode()) for _ in range(rng.integers(2, 9))}
        lefts, rights = zip(*sorted(both), strict=True)
        want = set()
        for i, j in itertools.combinations(range(len(both)), 2):
            left, right = len(os.path.commonprefix([lefts[i][::-1], lefts[j][::-1]])), len(os.path.commonprefix([rights[i], rights[j]]))
            a, b = lefts[i][len(lefts[i]) - left :], rights[i][:right]
            if left + right >= 4:
                want.add((left, right, tuple(m for m in range(len(both)) if lefts[m].endswith(a) and rights[m].startswith(b))))
        got = [(a, b, tuple(sorted(m))) for a, b, m in suffix_dedup.maximal_repeats(list(lefts), list(rights), 4)]
        assert len(got) == len(set(got)) and set(got) == want


def slow_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_brute_force(spark, sample, docs):
    for d in (sample, docs):
        rows = d.select("doc_id", "text").collect()
        got = quality.judge_quality(d).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((r.doc_id or -1, *slow_quality(r.text)) for r in rows)
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge_quality(docs.limit(0)).count() == 0
    junk = spark.createDataFrame([(i, " ".join(["word"] * 5 + [f"w{i}{j}{'%%%' if i == 7 else ''}" for j in range(40)]), "en", "s") for i in range(60)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.judge_quality(junk).where("not kept").collect()} == {7}


def test_sketches_merge(spark, sample):
    rows = quality.steps(quality.measure(sample))
    whole = {tuple(r) for r in quality.sketch(rows).collect()}
    half = quality.sketch(rows.where("doc_id % 2 = 0")).union(quality.sketch(rows.where("doc_id % 2 = 1")))
    assert {tuple(r) for r in half.groupBy("lang", "source", "measure", "step").agg(F.sum("n")).collect()} == whole


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "simhash_near_dedup":
            rows = sorted(before.collect(), key=lambda r: r.doc_id)
            want = {rows[t].doc_id for t in slow_near_copies([r.text for r in rows])}
            assert {r.doc_id for r in docs.collect()} == want and docs.count() == len(want)
        if name == "benchmark_decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            rows = before.collect()
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r, c in zip(rows, slow_contamination([r.text for r in rows], items), strict=True) if not c[-1]}
    assert docs.count() == before.count() and cp.run(spark, sf).count() == docs.count()


def test_line_sets_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [None, "", "\n\n", "A a b\n \n\tb B\x0bc\nc", "x" * 9000, "end", "é É\u3000z é", *("".join(rng.choice(list("abA \n\té"), n)) for n in rng.integers(0, 300, 60))]
    want = [(i, n, frozenset(w)) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if (w := re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))]
    for block, at_once in ((1 << 22, 1 << 20), (50, 7)):
        monkeypatch.setattr(line_join, "BLOCK", block)
        monkeypatch.setattr(line_join, "LINES_AT_ONCE", at_once)
        names = {}
        for shift in (0, 3):
            array = pa.array(texts).slice(shift)
            got = []
            for at, line, size, found in line_join.line_sets(array):
                parts = np.split(found, np.cumsum(size)[:-1])
                got += [(int(a) + shift, int(n), frozenset(map(int, p)), len(p)) for a, n, p in zip(at, line, parts, strict=True)]
            expected = [w for w in want if w[0] >= shift]
            assert [(g[0], g[1], g[3]) for g in got] == [(i, n, len(w)) for i, n, w in expected]
            for g, (_, _, w) in zip(got, expected, strict=True):
                assert names.setdefault(w, g[2]) == g[2]
        assert len(set(names.values())) == len(names)
    assert list(line_join.line_sets(pa.array([], pa.string()))) == []


def hot_parts(monkeypatch, part):
    """Deal tokens and cells with more than so many classes out as grids."""
    monkeypatch.setattr(set_join, "PART", part)


def test_token_counts_pass_over_the_buckets_once_for_as_many_tokens(monkeypatch):
    rng, passes, plain = np.random.default_rng(3), [], np.bincount
    found = [rng.integers(0, set_join.BUCKETS, n) for n in rng.integers(0, 3000, 1500)]
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or plain(*a, **k))
    got = set_join.bucket_totals(iter(found))
    assert len(passes) <= 1 + sum(map(len, found)) // set_join.BUCKETS and set_join.bucket_totals(iter([])).sum() == 0
    assert (got == plain(np.concatenate(found), minlength=set_join.BUCKETS)).all()


def test_line_join_equals_brute_force(spark, sample, docs, monkeypatch):
    near = [(i, "\n".join(f"w{i % 3} common line of several plain words number {(i + j) % 5} x{j}" for j in range(4)) + "\n \nunique" + str(i)) for i in range(30)]
    near += [(50, None), (51, ""), (52, near[0][1]), (None, near[1][1]), (None, near[1][1])]
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in range(40)]
    for i in range(80):  # a large group of near copies of a line, some links short of the threshold
        near.append((100 + i, " ".join(x if rng.random() > 0.08 else f"r{rng.integers(60)}" for x in base)))
    for df, part in ((spark.createDataFrame(near, "doc_id long, text string"), 1024), (spark.createDataFrame(near, "doc_id long, text string").repartition(7), 8), (sample.where("doc_id < 150").select("doc_id", "text"), 1024)):
        hot_parts(monkeypatch, part)
        rows = sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()}, key=lambda r: r[:2])
        lines = [(i if has else None, n, frozenset(x.lower().split())) for has, i, t in rows for n, x in enumerate(t.split("\n")) if x.split()]
        kinds = {s for _, _, s in lines}
        links = {s: sum(5 * len(s & o) >= 4 * len(s | o) for o in kinds) - 1 for s in kinds}
        want = Counter()
        for k, (i, n, s) in enumerate(lines):
            removed = any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:k])
            want[i, n, links[s], removed] += 1
        got = line_join.dedup_lines(df).collect()
        assert len(got) == df.count()
        once = {(r.has_id, r.id, r.row): r for r in got}
        assert Counter((r.id if r.has_id else None, x.line, x.links, x.removed) for r in once.values() for x in r.lines) == want
        classes = {}
        for r in once.values():
            for x in r.lines:
                classes.setdefault(x.class_id, x.links)
        assert len(classes) == len(kinds)
    assert line_join.dedup_lines(docs.limit(0)).count() == 0 and line_join.dedup_lines(docs).count() == len(TEXTS)


def test_drop_lines(spark, docs):
    df = spark.createDataFrame([(1, "a b c d e\nx", "k"), (2, "y\nA B C D E\n\n", "k"), (2, "y\nA B C D E\n\n", "k"), (3, None, "k"), (None, "a b c d e", "k")], "doc_id long, text string, lines string")
    got = sorted(map(tuple, line_join.drop_lines(df).collect()), key=str)
    assert got == sorted([(None, "a b c d e", "k"), (1, "x", "k"), (2, "y\n\n", "k"), (2, "y\n\n", "k"), (3, None, "k")], key=str)
    assert line_join.drop_lines(docs).columns == docs.columns and line_join.drop_lines(docs).count() == len(TEXTS)


def slow_near_copies(texts, percent=80, n=5):
    """Classes by brute force: every pair that shares a shingle is compared in full; the least row of each row's class."""
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    by = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            by.setdefault(x, []).append(i)
    forest = simhash.Forest(len(texts))
    for i, j in {p for own in by.values() for p in itertools.combinations(own, 2)}:
        if len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j]):
            forest.join(i, j)
    return [forest.top(i) for i in range(len(texts))]


def test_near_copies_equal_brute_force(spark, sample, docs, monkeypatch):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(3000)])
    passage = list(rng.choice(words, 40))
    made = []
    for i in range(60):  # copies with more and more changed words, next to unrelated texts with a common passage
        base = list(rng.choice(words, rng.integers(15, 150)))
        for changes in range(4):
            own = list(base)
            for k in rng.integers(0, len(own), changes):
                own[k] = "changed"
            made.append((None if i % 3 == 0 else len(made) // (2 if i % 3 == 1 else 1), " ".join([*own, *passage, *own[: i % 7]])))
    dense = list(rng.choice(words, 120))
    for k in range(120):  # a large group of near copies, with stragglers
        made.append((1000 + k, " ".join([*dense[:k], "x", *dense[k + 1 :]])))
        made.append((2000 + k, " ".join(rng.choice(words, 30)) + " " + " ".join(dense[k // 2 : k // 2 + 20])))
    made += [made[0], made[5], (None, None), (None, ""), (3000, " \n"), (3001, "a b"), (3002, "A  b"), (3003, "b a")]
    for df, part in ((spark.createDataFrame(made, "doc_id long, text string").repartition(3), 1024), (spark.createDataFrame(made, "doc_id long, text string"), 16), (sample.select("doc_id", "text"), 1024), (docs, 1024)):
        hot_parts(monkeypatch, part)
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        top = slow_near_copies([r.text for r in rows])
        kept = near_copies.drop_near_copies(df)
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        of = {}
        for r, t in zip(rows, top, strict=True):
            of.setdefault((r.doc_id, r.text), t)
        assert kept.columns == df.columns and sorted(of[k] for k in got.elements()) == sorted(set(top))
        least = {t: min((r.doc_id is None, r.doc_id or 0) for r, own in zip(rows, top, strict=True) if own == t) for t in set(top)}
        assert all(least[of[k]] == (k[0] is None, k[0] or 0) for k in got)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_lose_no_other_row(spark):
    text = lambda k: " ".join(f"{w}{k}" for w in "abcdefghijklmnopqrst")
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (None, None), (7, text(2)), (7, text(3)), (8, text(3)), (9, text(1)), (7, text(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(None, text(0)), (9, text(1)), (None, None), (7, text(2)), (7, text(3))])
    assert Counter(map(tuple, simhash.keep_one_of_each(df).collect())) == want
    assert Counter(map(tuple, near_copies.drop_near_copies(df).collect())) == want
    items = spark.createDataFrame([(1, text(0)), (2, text(2))], "item_id long, text string")
    assert Counter(map(tuple, decontam.drop_contaminated(df, items).collect())) == Counter(r for r in rows if r[1] not in (text(0), text(2)))


def test_quality_fences_come_from_the_data(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge_quality(docs).join(labels, "doc_id").where("not base_failed").select("quality", "kept", "n_symbols").collect()
    assert not [r for r in rows if r.quality == 0 and r.kept and r.n_symbols]
    assert sum(r.quality == 1 and not r.kept for r in rows) <= 5
    sketches = quality.sketch(quality.steps(quality.measure(docs)).where("n_words >= 20 and n_repeat_words * 100 <= n_words * 30"))
    limits = quality.fences(sketches).collect()
    for m in ("symbols_high", "word_length_low", "word_length_high"):
        assert len({r[m] for r in limits}) > len(limits) / 2, m


def test_quality_limits_differ_by_group_as_no_cutoff_could(spark):
    """The same text goes in a source of prose and stays in a source of code; limits and verdicts equal a plain computation."""
    words = lambda k: [f"w{k + 100}{j + 10}" for j in range(60)]
    rows = [(k, " ".join(w + ("#" * (k % 4) if j % 3 == 0 else "") for j, w in enumerate(words(k))), "en", "code") for k in range(100)]
    rows += [(1000 + k, " ".join(words(k)), "en", "prose") for k in range(100)]
    odd = " ".join(w + ("##" if j % 3 == 0 else "") for j, w in enumerate(words(7777)))
    rows += [(5000, odd, "en", "code"), (5001, odd, "en", "prose"), (5002, odd, "en", "small"), (5003, "###% " * 40, "en", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(df).collect()}
    assert kept[5000] and not kept[5001] and all(kept[i] for i in kept if i < 5000)
    measured = quality.steps(quality.measure(df)).where("n_words >= 20").collect()
    limits = {(r.lang, r.source): r for r in quality.fences(quality.sketch(quality.steps(quality.measure(df)).where("n_words >= 20"))).collect()}
    rank = lambda rows, p: sorted(rows)[-(-len(rows) * p // 100) - 1]

    def plain(rows):  # the logarithm of eight times the upper quartile, or of what could hide in a document of median length
        unseen = 30_000 / 2 ** (rank([math.floor(math.log2(r.word_chars) * 100) for r in rows], 50) / 100)
        return math.log2(8 * max(rank([r.symbols for r in rows], 75), unseen))

    wide = plain(measured)
    for source in ("code", "prose", "small"):
        own = [r for r in measured if r.source == source]
        limit = limits["en", source].symbols_high
        assert limit == pytest.approx(2 ** ((plain(own) * len(own) + wide * 10) / (len(own) + 10)))
