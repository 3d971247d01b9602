"""The corpus operators against brute-force versions, and their edge cases: nulls, empty and long texts, ties, repeated rows,
empty tables, other columns of clashing names."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cohortry.llm import exact_dedup, language, mixing, packing, quality_rules, rule_ensemble, sharding, simhash, token_counts, url_cascade
from cohortry.llm.shared import UnitCache, stored
from tests.conftest import SMALL

LONG = "lorem ipsum Dolor sit amet " * 3000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: doc_id, text, lang, source, n_chars and columns named like those that the operators make
ROWS = [(1, "A b c d e f", "en", "s1", 1, "x"), (2, "a B c d e f", None, "s1", 2, None), (2, "a B c d e f", None, "s1", 2, None), (None, None, "en", None, None, "y"),
        (3, "", "de", "s2", 0, "z"), (4, " \n\t ", "de", "s2", 4, "z"), (5, LONG, "en", None, len(LONG), "w"), (6, "été ÉTÉ 1 | 2", "fr", "s3", None, "v"), (7, "a b c d e g", "en", "s3", 1, "u")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
CLASH = ("fp", "kept", "place", "bucket", "file", "row", "stratum", "length", "rank", "keys")


@pytest.fixture(scope="module")
def odd(spark):
    return stored(spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}), "odd")


@pytest.fixture(scope="module")
def none(odd):
    return stored(odd.limit(0), "none")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def results(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SMALL).collect()]


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in documents(spark).select("doc_id", "text").collect()}


def test_mix_matches_water_filling(spark):
    rows = results(spark, "op1_mix_sources")
    docs = {r["doc_id"]: r for r in documents(spark).collect()}
    size = {i: len(WORDS.findall(d["text"] or "")) for i, d in docs.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    total = defaultdict(int)
    for i, d in docs.items():
        total[d["source"]] += size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * total[s] <= level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    taken = defaultdict(int)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["target"] == pytest.approx(target[source]) and r["taken"] in [k * r["size"] for k in range(4)]
        taken[source] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i, d in docs.items() if d["source"] == s)
    assert sorted(map(str, rows)) == sorted(map(str, results(spark, "op1_mix_sources")))


def test_mix_edge_cases(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and max(Counter(r["doc_id"] for r in out.collect() if r["doc_id"] not in (2, None)).values()) <= 3
    assert mixing.mix(none).count() == 0


def test_clamped_sources(spark):
    s = spark.createDataFrame([("a", 10, 3.0), ("b", 1000, 1.0), ("c", 0, 2.0)], "source string, source_size long, weight double")
    assert {r["source"]: r["target"] for r in mixing.water_fill(s, 3.0).collect()} == {"a": 30.0, "b": 980.0, "c": 0.0}


def test_cascade_is_exact(spark):
    listed = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_cascade.build(listed, universe)
    rows = url_cascade._hashed(universe).toPandas()
    said = cascade.members(rows["a"].to_numpy(), rows["b"].to_numpy())
    assert set(rows["key"][said]) == {f"k{i}" for i in range(500)} and len(cascade.levels) > 1


def test_urls(spark):
    from cohortry.llm.queries import URL_RULES
    urls = {1: None, 2: "no scheme", 3: "http://WWW.Example.com/en/x", 4: "https://a.example.com/en/?q", 5: "http://example.com/fr", 6: "x://b.net/es/1#t",
            7: "http://notexample.com/en/", 8: "http://net", 9: "http://a.net/fr/", 10: ""}
    pages = spark.createDataFrame(list(urls.items()) + [(3, urls[3])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_cascade.judge(pages, URL_RULES).collect()}
    assert got == {1: ("", None, "allow"), 2: ("", None, "allow"), 3: ("www.example.com", "www.example.com/en/", "allow"), 4: ("a.example.com", "example.com/en/", "block"),
                   5: ("example.com", "com/", "allow"), 6: ("b.net", "net/es/", "block"), 7: ("notexample.com", "com/", "allow"), 8: ("net", None, "allow"),
                   9: ("a.net", "net/fr/", "block"), 10: ("", None, "allow")}
    assert url_cascade.judge(pages.limit(0), URL_RULES).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "example.com/en/" + "x/" * 100_000)], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in url_cascade.judge(long, URL_RULES).collect()] == [("example.com/en/", "block")]


def base(text):
    words = WORDS.findall(text)
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    lines = [s for s in text.split("\n") if WORDS.search(s)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = {i: base(t) for i, t in texts(spark).items()}
    rows = results(spark, "op3_quality_rules")
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality_rules.base_statistics(odd).collect()}
    assert got == {r[0]: base(r[1] or "") for r in ROWS}


def test_binomial_bound(spark):
    cases = [(k, n, a) for n in (1, 50, 400, 3000) for k in (0, 1, 3, 10) if k <= n for a in (0.005, 0.02)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long").distinct()
    for a in (0.005, 0.02):
        for r in df.withColumn("ok", quality_rules.risk_is_below(F.col("k"), F.col("n"), a, F.lit(0.01))).collect():
            tail = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(j + 1) - math.lgamma(r["n"] - j + 1) + j * math.log(a) + (r["n"] - j) * math.log(1 - a)) for j in range(r["k"] + 1))
            assert r["ok"] == (r["k"] < r["n"] * a and tail <= 0.01)


def test_cutoffs_reject_junk_and_spare_good(spark, none):
    text = F.when(F.col("id") % 10 == 0, F.repeat(F.concat(F.lit("ab## "), F.col("id").cast("string"), F.lit(" ")), 15)).otherwise(
        F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("word"), (F.col("id") * 31 + i).cast("string")))))
    text = F.when(F.col("id") % 10 == 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("ab##"), (F.col("id") * 31 + i).cast("string"))))).otherwise(text)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("clash").alias("stratum"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i in range(6000) if i % 10}
    assert quality_rules.keep_good(docs, labels.limit(0)).count() == 6000
    assert quality_rules.keep_good(none, labels).count() == 0


def test_small_strata_get_cutoffs(spark):
    # good labels by stratum, and how many of them have a symbol rate of 0.12
    strata = {"a": (200, 0), "b": (200, 20), "c": (150, 0), "d": (90, 0), "e": (80, 0)}
    rows = [(s, 12 if i < high else 0) for s, (n, high) in strata.items() for i in range(n)]
    stats = spark.createDataFrame(rows, "stratum string, n_symbols long").select(
        "*", F.lit(20).alias("n_words"), *[F.lit(100).alias(c) for c in ("word_chars", "n_lines")],
        *[F.lit(0).alias(c) for c in ("n_dup_lines", "n_repeat_words", "n_upper", "n_marks")])
    cuts = {r["stratum"]: r for r in quality_rules.certified_cutoffs(stats).collect()}
    assert {s: (r["cut_symbols"], r["pooled"], r["n"]) for s, r in cuts.items()} == {
        "a": (0.02, False, 200), "b": (0.15, False, 200), "c": (0.02, True, 320), "d": (0.02, True, 320), "e": (0.02, True, 320)}
    assert quality_rules.least_labels(5) == 152 and quality_rules.least_labels(4) == 144


def test_language(spark, odd, none):
    lang = {r["doc_id"]: r["lang"] for r in documents(spark).collect()}
    rows = results(spark, "op4_identify_language")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    model = language.fit(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert got[None] == ("und", 0.0) and got[3] == ("und", 0.0) and got[4] == ("und", 0.0) and got[6][0] == "fr"
    assert language.fit(none) is None and {r["lang_pred"] for r in language.predict(odd, None).collect()} == {"und"}
    assert language.predict(none, model).count() == 0
    # a text that a third of the rows repeat teaches once
    few = [(f"das ist der {w} und die {w} ist nicht da", "de") for w in ("Baum", "Weg", "Wald")] + [(f"the {w} is here and it was not there", "en") for w in ("tree", "way", "wood")]
    copies = spark.createDataFrame(few + [("one and the same", "en")] * 6000, "text string, lang string").withColumn("doc_id", F.lit(1))
    for seed in (3, 8):
        model = language.fit(copies, seed=seed)
        assert model.languages == ["de", "en"]
        said = {(r["doc_id"], r["lang_pred"]) for r in language.predict(copies.withColumn("doc_id", (F.col("lang") == "de").cast("int")).filter("text <> 'one and the same'"), model).collect()}
        assert said == {(1, "de"), (0, "en")}
    # a language of one text, however often it stands, is learned at any seed
    one = spark.createDataFrame([("der die das ist nicht da und wo", "de")] * 3000 + [(f"the {i} is here and it was not there", "en") for i in range(50)], "text string, lang string")
    assert all(language.fit(one, seed=seed).languages == ["de", "en"] for seed in range(1, 11))


def test_sharding(spark, odd, none):
    rows = results(spark, "op5_shuffle_shards")
    want = texts(spark)
    slots = defaultdict(list)
    for r in rows:
        assert r["text_crc32"] == zlib.crc32(want[r["doc_id"]].encode()) and r["size"] == len(want[r["doc_id"]].encode()) + 8
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in rows) == sorted(want) and set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, results(spark, "op5_shuffle_shards")))
    small = sharding.write_shards(odd, 4, bucket_bytes=100)
    assert sorted(str(r["doc"]) for r in small.collect()) == sorted(str(r) for r in odd.collect())
    assert sharding.write_shards(none, 4).count() == 0


def test_bucket_starts(spark):
    counts = spark.range(3000).select(F.col("id").alias("bucket"), (F.col("id") % 7).alias("n"))
    want = np.concatenate(([0], np.cumsum([i % 7 for i in range(3000)])[:-1]))
    assert [r["start"] for r in sharding.bucket_starts(counts).orderBy("bucket").collect()] == want.tolist()


def test_rule_ensemble(spark, odd, none):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = results(spark, "op6_score_quality")
    assert len(rows) == documents(spark).count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    known = [r for r in rows if r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in known) >= 0.85 * len(known)
    stats = rule_ensemble.statistics(odd)
    model = rule_ensemble.fit(stats.withColumn("label", F.lit(1.0)))
    assert all(0.5 < r["s"] < 1 for r in stats.select(model.score().alias("s")).collect())
    assert rule_ensemble.statistics(none).count() == 0


def test_paths_of_a_tree():
    text = "Tree 0\n If (feature 0 <= 2.5)\n  If (feature 2 <= 0.5)\n   Predict: 0.0\n  Else (feature 2 > 0.5)\n   Predict: 1.0\n Else (feature 0 > 2.5)\n  Predict: 1.0\n"
    assert [r.terms for r in rule_ensemble.paths(text)] == [
        (("n_words", False, 2.5),), (("n_words", False, 2.5), ("symbols", False, 0.5)), (("n_words", False, 2.5), ("symbols", True, 0.5)), (("n_words", True, 2.5),)]


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(marks):
    ids = list(marks)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, odd, none):
    marks = {i: plain_fingerprint(t) for i, t in texts(spark).items()}
    rows = results(spark, "op7_simhash_groups")
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == marks
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(marks)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [1, 3, 5, 6, 7]  # 2 is near 1, 4 and the row without an identifier are near 3
    assert simhash.near_groups(none).count() == 0


def test_one_of_each_group_stays_by_row(spark):
    same, other = "a b c d e f g h", "quite another text that is like nothing else here at all"
    rows = [(1, same), (2, same), (2, other), (None, other + " whatsoever in it"), (None, "nobody knows this one or its like"), (None, same), (3, None), (3, "")]
    kept = simhash.keep_one(stored(spark.createDataFrame(rows, "doc_id long, text string"), "rows"))
    fps = components({i: plain_fingerprint(t or "") for i, (_, t) in enumerate(rows)})
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[fps[i]].append((doc is None, doc or 0, plain_fingerprint(text or ""), text or ""))
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    want = Counter()
    for group in groups.values():
        first = min(group)
        want[None if first[0] else first[1], first[3]] += sum(g[:2] == first[:2] and g[3] == first[3] for g in group)
    assert got == want and (2, other) in got and (None, "nobody knows this one or its like") in got


def test_vantage_trees_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for s in seeds[:200] for k in (1, 3, 5)]
    fps = np.unique(np.concatenate((seeds, np.array(near, np.uint64))))
    monkeypatch.setattr(simhash, "LEAF", 16)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in simhash.stars(simhash.links(df, 4)).collect()}
    label = simhash._root(simhash._brute(fps, len(fps), 4, np.arange(len(fps)), np.arange(len(fps))))
    root = lambda x: got.get(x, x)
    ours = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        ours[root(x)].add(x)
    theirs = defaultdict(set)
    for x, l in zip(fps.view(np.int64).tolist(), label.tolist()):
        theirs[l].add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("which", [0, 1])
def test_large_shard_loses_no_link(which):
    half = simhash.halves(4)[which]
    rng = np.random.default_rng(which)
    home = np.unique(rng.integers(0, 2**63, 3 * simhash.LEAF, dtype=np.uint64))
    assert len(home) > 2 * simhash.LEAF
    # each asking point differs from one home point by the half's radius, in bits that the half looks at
    low = 32 if half.mask >> 32 else 0
    asks = home.copy()
    for i in range(len(asks)):
        for b in rng.choice(32, half.radius, replace=False):
            asks[i] ^= np.uint64(1) << np.uint64(low + b)
    x = np.concatenate((home, asks))
    everyone = np.arange(len(x))
    want = simhash._root(simhash._brute(x, len(home), 4, everyone.copy(), everyone))
    ours = simhash._root(simhash._unite(x, len(home), 4, half, everyone.copy(), everyone))
    # every home point and the point made from it are linked; all components are those of the brute force
    assert (want[:len(home)] == want[len(home):]).all()
    assert len(np.unique(np.stack((want, ours)), axis=1).T) == len(np.unique(want)) == len(np.unique(ours))


def test_token_counts(spark, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = texts(spark)
    for r in results(spark, "op8_count_tokens"):
        n = len(model.encode(want[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(want[r["doc_id"]].encode()), n > 4096)
    assert token_counts.prefix_counts(none, path).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "\n\na", "a \n b\t", "▁x ▁", "日本 é\x00<s></s>", "don't  stop", "word\nWord\n", "aaaa" * 20])
def test_every_prefix(text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    steps = token_counts.counter(path)([text])[0]
    counts = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
    assert [token_counts.tokens_at(steps, i) for i in range(len(text) + 1)] == counts
    for budget in (0, 1, 3):
        assert token_counts.cut_at(steps, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def test_dedup(spark, odd, none):
    got = sorted((r["id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect())
    assert got == [(0, 3, 2, False), (1, 2, 3, False), (2, 2, 3, False), (2, 2, 3, True), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True)]
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5, 6, 7]
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def test_dedup_checks_bytes(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB"), (4, "ef"), (5, "cd"), (6, "x")], "doc_id long, text string")
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, digest=F.length).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (5, 2, False), 5: (5, 2, True), 4: (4, 1, True), 6: (6, 1, True)}


def test_dedup_state_goes_on(spark, tmp_path):
    ledger = exact_dedup.Ledger(spark, str(tmp_path / "ledger"))
    for batch in ([(1, "a"), (2, "b")], [(9, "a")]):
        ledger.absorb(spark.createDataFrame([(t, i, "f", i) for i, t in batch], "digest string, id long, file string, row long"))
    assert {(r["digest"], r["keep_id"], r["n"]) for r in ledger.retained().collect()} == {("a", 9, 2), ("b", 2, 1)}


def check_packing(rows, limit):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= limit
    return len(places)


def test_packing(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = results(spark, "op10_pack_sequences")
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, text in texts(spark).items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at:at + r["length"]].tobytes())) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)
    assert check_packing(rows, 2048) <= 1.02 * math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    own = packing.pack(stored(packing.token_pieces(odd, path, 64), "pieces"), 64)
    check_packing(own.collect(), 64)
    assert packing.sequences(own).agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * own.agg(F.sum("length")).first()[0]
    assert packing.pack(stored(packing.token_pieces(none, path), "pieces")).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "\n\n a", "x\t y", "it's <|endoftext|> so", "!\x1c?", "é ö", "a\n"])
def test_encoder_equals_the_library(text):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(encode([text])[0], "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_encoded_in_rows_equal_the_library():
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [w + str(i) for i, w in enumerate(["it's", "<|endoftext|>", "été", "日本", "a_b", "3.14", "\u0120x", "Ċ"] * 90)]
    texts = [" ".join(words), "\n".join(words[::-1]), " ".join(words) + " ", " " + "\n".join(words)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_unit_cache_is_bounded():
    calls = []
    cache = UnitCache(lambda units: calls.append(units) or map(str.upper, units), limit=100, chars=50)
    for n in range(40):
        units = ["kept", f"w{n}" * 5]
        assert [cache.table(units)[u] for u in units] == [u.upper() for u in units]
        assert sum(map(len, cache.young)) <= 50 and sum(map(len, cache.old)) <= 50
    assert sum("kept" in c for c in calls) == 1
    long = ["x" * 80, "y" * 80]
    assert [cache.table(long)[u] for u in long] == [u.upper() for u in long]


def least_sequences(pieces, limit):
    """The exact optimum of a few pieces, by trying all places."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in sorted({r for r in rooms if r >= pieces[i]}):
            rest = list(rooms)
            rest.remove(k)
            place(i + 1, [*rest, k - pieces[i]])
        place(i + 1, [*rooms, limit - pieces[i]])
    place(0, [])
    return best[0]


def plain_best_fit(histogram, limit):
    left = np.zeros(limit + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    return sum(n for _, n in packing.best_fit(left, limit))


def check_configurations(histogram, limit):
    found, packed = Counter(), packing.configurations(histogram, limit)
    for config, times in packed.configurations:
        assert sum(s * c for s, c in config.items()) <= limit
        for s, c in config.items():
            found[s] += c * times
    assert found == histogram and packed.bound <= packed.sequences <= plain_best_fit(histogram, limit)
    return packed


def test_configurations_cover_the_histogram():
    rng = np.random.default_rng(1)
    packed = check_configurations(Counter(rng.integers(1, 101, 5000).tolist()), 100)
    assert packed.sequences <= 1.005 * packed.bound + 1
    assert check_configurations(Counter({1: 5}), 100).sequences == 1 and packing.configurations({}, 100).configurations == []
    assert check_configurations(Counter({100: 7}), 100).sequences == 7
    for _ in range(15):
        pieces = rng.integers(10, 60, 9).tolist()
        few = check_configurations(Counter(pieces), 100)
        assert few.bound <= least_sequences(pieces, 100) <= few.sequences <= least_sequences(pieces, 100) + 1


def test_configurations_of_lengths_that_best_fit_packs_badly():
    rng = np.random.default_rng(2)
    histogram = Counter(rng.integers(400, 901, 100_000).tolist())
    packed = check_configurations(histogram, 2048)
    assert packed.sequences <= 1.005 * packed.bound and plain_best_fit(histogram, 2048) > 1.05 * packed.bound
    # lengths of three configurations: 1000 + 1000, 700 + 700, 340 * 6 and mixtures of them
    few = check_configurations(Counter({700: 1000, 1000: 800, 340: 1500, 1030: 300}), 2048)
    assert few.sequences <= 1.01 * few.bound


def test_pipeline(spark):
    docs = documents(spark)
    want = texts(spark)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), name)
        if name == "quality_rules":
            good = {i for i, t in want.items() if base(t)[0] >= 20 and 100 * base(t)[4] <= 30 * base(t)[0]}
            assert {r["doc_id"] for r in docs.collect()} <= good
        if name == "exact_dedup":
            lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
            last = {lower(r["text"]): r["doc_id"] for r in sorted(before.collect(), key=lambda r: r["doc_id"])}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(last.values())
        if name == "simhash_dedup":
            roots = components({r["doc_id"]: plain_fingerprint(r["text"]) for r in before.collect()})
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(roots.values()))
        if name != "pack_sequences":
            assert docs.columns == before.columns
    check_packing([r.asDict() for r in docs.collect()], 2048)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Empty tables, repeated and missing identifiers."""
    docs = documents(spark)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    labels.write.parquet(f"{tmp_path}/odd/labels.parquet")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, 7).when(F.col("doc_id") % 5 == 1, F.lit(None)).otherwise(F.col("doc_id")))
    odd.union(docs.limit(9)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, now = now, stored(stage(spark, now, f"{tmp_path}/odd"), name)
        if name == "simhash_dedup":
            marks = dict(enumerate(plain_fingerprint(r["text"]) for r in before.collect()))
            assert now.count() == len(set(components(marks).values()))
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
