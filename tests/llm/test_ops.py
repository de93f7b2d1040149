"""Each operator on a small table with nulls, empty and long texts, ties, repeats, clashing columns; and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nexuloom.llm import chat, common, decontaminate, graph, language, mixing, quality, queries, rules, sharding, simhash, suffix, tokens

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h int, key string, score string, fp string, part string"


def make(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(200)]
    words = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = words(45)
    out = [(i, words(r.randint(1, 150)).replace(" q", "\n"), r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None])) for i in range(n)]
    out += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \n\t ", "fr", "b"), (n + 3, words(6000), "en", "a"), (n + 4, "x", "en", "é"), (n + 5, "12 34 ... !!", None, "z")]
    out += [(n + 10 + i, f"{words(20)} {passage} {words(9)}", "en", "b") for i in range(4)]
    out += [(n + 20 + i, out[0][1], "en", "b") for i in range(12)]  # a group of copies
    out += [(n + 40 + i, out[1][1] + (" " + words(1)) * (i % 2), "en", "b") for i in range(4)]
    out += [(n + 50, "ab " * 400, "fr", "a"), (n + 51, ("line one\nline two\n") * 30, "en", "a"), (n + 52, "é" * 150 + "ü" * 150 + "é" * 150, "fr", "a")]
    return [(d, t, lang, s, len(t or ""), "1", 2, "k", "s", "f", "p") for d, t, lang, s in out]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        assert r[key] not in out
        out[r[key]] = r
    return out


# ---- 1 --------------------------------------------------------------------------------------------------------------


def test_mix(docs, rows, none):
    got = by_id(mixing.mix(docs))
    size = {r[0]: len(brute.words(r[1])) for r in rows}
    assert {d: r["size"] for d, r in got.items()} == size
    source = {r[0]: r[3] for r in rows}
    total = {}
    for d, s in source.items():
        total[s] = total.get(s, 0) + size[d]
    want = brute.mix_targets(total)
    taken = dict.fromkeys(total, 0)
    for d, r in got.items():
        assert r["source_size"] == total[source[d]] and r["target"] == pytest.approx(want[source[d]])
        assert r["taken"] % max(1, size[d]) == 0 and r["taken"] <= 3 * size[d]
        taken[source[d]] += r["taken"]
    assert sum(taken.values()) <= sum(size.values()) < sum(taken.values()) + max(size.values()) + 1
    for s in total:
        assert abs(taken[s] - want[s]) <= max(size[d] for d in size if source[d] == s) + max(size.values()) * 0.2
    again = by_id(mixing.mix(docs.repartition(7)))
    assert {d: r["taken"] for d, r in got.items()} == {d: r["taken"] for d, r in again.items()}
    assert mixing.mix(none).count() == 0


def test_what_the_mix_takes(docs, rows, spark):
    """Which documents are taken, and how often, against a plain queue."""
    got = by_id(mixing.mix(docs))
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).collect()}
    line = [(r[3], (h[r[0]], r[0]), len(brute.words(r[1]))) for r in rows]
    taken = brute.mix_taken(line, {r[3]: got[r[0]]["target"] for r in rows}, sum(x[2] for x in line))
    assert {r[0]: n for r, n in zip(rows, taken)} == {d: r["copies"] for d, r in got.items()}


def test_mix_loses_no_row(spark):
    """Rows that differ only in which column is null, and identical rows."""
    d = [(1, "one two", None, "s"), (1, None, "one two", "s")] + [(2, "three four five", None, "s")] * 3 + [(None, "six", "x", None)] * 2
    docs = spark.createDataFrame(d, "doc_id long, text string, note string, source string")
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    got = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    assert len(got) == copies and set(got) <= set(d) and (1, "one two", None, "s") in got


def test_mixed_documents(docs, rows, spark):
    twice = docs.unionByName(docs.filter("doc_id = 3"))
    d = mixing.mixed_documents(twice)
    assert d.columns == docs.columns
    want = {}
    for r in mixing.mix(twice).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    assert {r["doc_id"]: r["n"] for r in d.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in want.items() if v}


def test_mix_comes_in_its_order(docs, spark, monkeypatch):
    """The words of every prefix come near to the weights; a narrow cut is the same as one window's."""
    wide = by_id(mixing.mix(docs))
    monkeypatch.setattr(mixing, "MOST_SORTED", 3)
    assert by_id(mixing.mix(docs)) == wide
    kept = mixing.mix(docs.withColumn("row", F.monotonically_increasing_id()), key="row").filter("copies > 0").collect()
    want = sorted(((e * r["source_size"] + r["upto"]) / r["target"], r["rank"], r["nth"], e, r["doc_id"]) for r in kept for e in range(r["copies"]))
    assert [r["doc_id"] for r in mixing.mixed_documents(docs).select("doc_id").collect()] == [x[-1] for x in want]


def test_mix_of_no_words(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(d).collect()] == [(0, 0, 0.0)] * 2


# ---- 2 --------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = queries.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (d["predicted"] == d["quality"]).mean() > 0.95 and d["score"].between(0, 1).all()


def test_quality_cases(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, F.lit(True))
    s = quality.score(docs, model, ["doc_id"])
    assert s.count() == docs.count() and s.filter("score IS NULL OR predicted IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.score(none, model, ["doc_id"]).count() == 0
    blank = quality.train(docs, labels.limit(0), F.lit(True))
    assert quality.score(docs, blank, ["doc_id"]).filter("predicted = 0").count() == 0 and blank.rules == []


@pytest.mark.parametrize("table", ["fixture", "sf0.01"])
def test_quality_against_plain_rules(spark, docs, table):
    """Every score against the same rules over plain statistics."""
    labels = common.read(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(common.read(spark, "/root/testdata/sf0.01", "documents"), labels, ~queries.held_out())
    assert model.rules
    d = docs if table == "fixture" else common.read(spark, "/root/testdata/sf0.01", "documents")
    plain = [(w, tuple((n.removeprefix("__s_"), left, t) for n, left, t in rule)) for w, rule in model.rules]
    want = {r["doc_id"]: brute.quality_score(r["text"], model.bias, plain) for r in d.select("doc_id", "text").collect()}
    got = by_id(quality.score(d, model, ["doc_id"]))
    assert all(got[k]["score"] == pytest.approx(v, abs=1e-9) and got[k]["predicted"] == (v >= 0.7) for k, v in want.items()) and len(got) == len(want)
    assert sorted(r["doc_id"] for r in quality.accepted(d, model).collect()) == sorted(k for k, v in want.items() if v >= 0.7)


def test_quality_of_a_null_id(spark):
    d = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string").withColumn("held_out", queries.held_out())
    labels = spark.createDataFrame([(None, 1), (1, 0)], "doc_id long, quality int")
    model = quality.train(d, labels, F.lit(True))
    assert quality.score(d, model, ["doc_id", "held_out"]).count() == 2 and quality.accepted(d, model).count() == 0


def test_rules_say_what_the_trees_say(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    m = quality.fit(x, y, ["a", "b"])
    d = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double").select(m.column().alias("s")).toPandas()["s"].to_numpy()
    assert ((d > 0.5) == (y > 0.5)).mean() > 0.97 and 0 < len(m.rules) < 80
    z = np.full(len(x), m.bias)
    for w, rule in m.rules:
        z += w * np.logical_and.reduce([(x[:, "ab".index(c)] <= t) if left else (x[:, "ab".index(c)] > t) for c, left, t in rule])
    assert np.allclose(d, 1 / (1 + np.exp(-z)))


# ---- 3 --------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    d = queries.op3_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (d["lang_pred"] == d["lang"]).mean() > 0.97


def test_language_against_plain_sums(docs, rows, none):
    model = language.train(docs, F.lit(True))
    assert model[0] == ["en", "fr"]
    bits = 14
    got = by_id(language.predict(docs, model))
    for d, t, *_ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        sums = np.zeros(2)
        for h in language.grams(language.codes(f" {t} "), bits):
            sums += model[1][h].astype(float).sum(axis=0)
        assert got[d]["lang_pred"] == model[0][int(sums.argmax())] or abs(sums[0] - sums[1]) < 1e-6
        assert got[d]["score"] == pytest.approx(1 / np.exp(sums - sums.max()).sum(), abs=1e-6)
    assert language.predict(none, model).count() == 0
    empty = language.train(none, F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}


def test_language_of_short_texts_at_every_place(spark):
    model = language.train(spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour", "fr")], "doc_id long, text string, lang string"), F.lit(True))
    r = random.Random(3)
    for _ in range(3):
        texts = [r.choice(["", None, "a", " ", "\n", "é", "hello", "bonjour", "ab"]) for _ in range(r.randint(1, 7))]
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        got = by_id(language.predict(d, model))
        for i, t in enumerate(texts):
            assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), texts
            alone = language.predict(d.filter(F.col("doc_id") == i), model).head()
            assert alone["lang_pred"] == got[i]["lang_pred"] and alone["score"] == pytest.approx(got[i]["score"])


def test_language_of_a_last_text_that_is_empty(spark):
    model = language.train(spark.createDataFrame([(1, "hello there", "en"), (2, "bonjour", "fr")], "doc_id long, text string, lang string"), F.lit(True))
    for last in ("", None):
        d = spark.createDataFrame([(1, "hello"), (2, "bonjour"), (3, last)], "doc_id long, text string").coalesce(1)
        got = by_id(language.predict(d, model))
        assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "fr", "und"]


# ---- 4 --------------------------------------------------------------------------------------------------------------


def test_tokens_round_trip(spark, docs, rows, tmp_path):
    import xxhash
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    more = [(-5, "a  b\n\n c", None, None), (3, "again", None, None), (None, "no id", None, None), (None, None, None, None), (500, "x <|endoftext|> y\tz\nq", None, None)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in more], "doc_id long, text string"))
    m = tokens.write_tokens(table, f"file://{tmp_path}/t", queries.vocabulary(), shards=5)
    got = tokens.read_records(m, f"file://{tmp_path}/t").collect()
    want, at = [], 0
    digest = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    every = sorted([(r[0], r[1] or "") for r in rows] + [(x[0], x[1] or "") for x in more], key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1])))
    for d, text in every:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r[:4]) for r in got), key=lambda r: r[1]) == want
    shards = {r["name"]: r["width"] for r in m.collect()}
    assert len(shards) > 1 and set(shards.values()) == {2}
    hits = [x for n, w in shards.items() if (x := tokens.lookup(f"{tmp_path}/t", n, w, 500)) is not None]
    assert len(hits) == 1 and hits[0].tolist() == [*t.encode(more[-1][1], add_special_tokens=False).ids, 0]
    assert all(tokens.lookup(f"{tmp_path}/t", n, w, 10**12) is None for n, w in shards.items())
    assert tokens.encode_and_read(spark, table.limit(0), queries.vocabulary()).count() == 0


def test_one_id_in_many_shards(spark, tmp_path):
    d = spark.createDataFrame([(7, f"text {i % 40}") for i in range(400)] + [(None, "x")] * 100, "doc_id long, text string")
    m = tokens.write_tokens(d, f"file://{tmp_path}/t", queries.vocabulary(), shards=6)
    got = sorted(tokens.read_records(m, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    assert m.count() > 3 and [r["doc_id"] for r in got] == [None] * 100 + [7] * 400
    assert got[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))


def test_a_lookup_reads_little(tmp_path, monkeypatch):
    """The bytes read do not grow with the shard."""
    read = {}
    for n in (2_000, 60_000):
        ids, zero = np.arange(n) * 3, np.zeros(n, np.int64)
        (tmp_path / "s.mph").write_bytes(tokens.pack_index(ids, zero.astype(bool), zero, np.arange(n), zero + 1))
        (tmp_path / "s.ids").write_bytes(np.arange(n).astype("<u2").tobytes())
        fs, counted = tokens.pafs.LocalFileSystem(), []

        class Files:
            def open_input_file(self, path):
                f = fs.open_input_file(path)

                class Counted:
                    def __enter__(self):
                        return self

                    def __exit__(self, *x):
                        f.close()

                    def read_at(self, size, at):
                        counted.append(size)
                        return f.read_at(size, at)

                return Counted()

        monkeypatch.setattr(tokens, "file_system", lambda folder: (Files(), folder))
        for i in (0, n // 2, n - 1):
            assert tokens.lookup(str(tmp_path), "s", 2, int(ids[i]))[0] == i % (1 << 16)
        assert tokens.lookup(str(tmp_path), "s", 2, 1) is None
        read[n] = sum(counted)
    assert read[60_000] < read[2_000] + 2_000


def test_the_piece_cache_is_bounded():
    e = tokens.Encoder(queries.vocabulary(), cache=10_000)
    r = random.Random(1)
    for k in range(30):
        text = " ".join(f"{r.choice('abcdef')}{r.randint(0, 9999)}," for _ in range(60))
        assert e([text]) == e.whole([text]) and len(e.cache) <= 10_000 // e.ENTRY + 121


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 30000):
        h = tokens.key_hash(np.arange(n) * 7, np.zeros(n, bool), np.zeros(n, int), 0)
        f = tokens.PerfectHash.build(h)
        g, _ = tokens.PerfectHash.unpack(memoryview(f.pack()))
        assert sorted(g.places(h).tolist()) == list(range(n))


# ---- 5 --------------------------------------------------------------------------------------------------------------


def bench(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_reparameterised_questions(spark, none):
    item = "A train leaves the station at 12 and travels 340 km in 5 hours while Peter walks 3 miles every day, how far is Peter from the station at 12 today"
    other = "What is the name of the river that runs through the old town and ends in the northern sea after many long bends"
    changed = item.replace("12", "9").replace("340", "77").replace("Peter", "Maria").replace("km", "miles")
    docs = [(1, f"Some words. {item} and then some."), (2, f"Before it. {changed} After it."), (3, changed.replace("at 9 today", "at 8 today") + "."), (4, item.upper()), (5, item.lower()), (6, "A train leaves the station at 12 and then nothing like it follows at all here."), (7, None), (8, ""), (9, other[: len(other) // 2]), (10, f"{other}\n{item}"), (10, f"{other}\n{item}"), (11, "short one")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit("clash")).withColumn("h", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench(spark, [item, other, None, "", "short one"])).collect()}
    assert got == {(1, 0), (2, 0), (4, 0), (5, 0), (10, 0), (10, 1), (11, 4)}
    assert {r["doc_id"] for r in decontaminate.clean(d, bench(spark, [item])).collect()} == {3, 6, 7, 8, 9, 11}
    assert decontaminate.contaminated(none, bench(spark, [item])).count() == 0 and decontaminate.contaminated(d, bench(spark, [item]).limit(0)).count() == 0


def test_other_placeholders_in_the_document(spark):
    items = ["On Monday Maria bought 12 apples for 3 dollars and sold 5 of them to Peter for 2 dollars each.", "Water boils at one hundred degrees", "Seven old men walk home"]
    docs = [(1, items[0].lower()), (2, f'The note says, {items[1]}, and more'), (3, f"He wrote {items[2]} on the wall"), (4, "On Monday Maria bought apples and sold some of them to Peter.")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got) == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]


def test_dense_questions(spark):
    items = ["What is 12 + 7 * 3 - 5 + 9?", "A train runs 120 km in 3 hours and then 90 km in 2 hours. What is 15 + 7 * 3 - 4 + 9?", "12 7 5 9 4 6"]
    docs = [(1, "Before it. What is 14 + 8 * 2 - 6 + 11? After it."), (2, "A train runs 80 km in 5 hours and then 70 km in 6 hours. What is 11 + 8 * 5 - 9 + 10?"), (3, "What is 14 + 8 * 2 - 6 + 11? 5 6 7 8"), (4, "What was 14 + 8 * 2 - 6 + 11?"), (5, "1 2 3 " * 4000), (6, "see 12 7 5 9 4 6 there"), (7, "")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in got) == [(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, 1.0), (6, 2, 1.0)]  # the second holds the first


def test_plain_words_around(spark):
    for words in (["#"], ["a"], ["a", "b"], list("#a##bc#@~"), list("ab#####"), list("####ab"), list("#####"), list("#a#")):
        after, before = decontaminate.plain_around(F.array(*map(F.lit, words)))
        got = spark.range(1).select(after.alias("after"), before.alias("before")).head()
        plain = [(i, w) for i, w in enumerate(words) if w not in "#@~"]
        for i in range(len(words)):
            up, down = [x for x in plain if x[0] >= i][:2], [x for x in plain if x[0] <= i][-2:]
            for have, want in ((got["after"], up), (got["before"], down)):
                x = have[i] if i < len(have) else None
                assert (x and [tuple(x["p"]), tuple(x["q"])]) == (want if len(want) == 2 else None), (words, i)


def test_windows_are_made_of_texts_with_telling_words(spark, monkeypatch):
    """Texts that lack an item's telling words are left out before their windows are made; results are the same."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(5, 9)))
    items = {i: " ".join(word() for _ in range(r.choice([1, 3, 6, 20, 45]))) for i in range(30)} | {90: "Σας ΑΣ.Β ΟΔΟΣ", 91: "It cost 30 dollars", 92: "5 6 7 8 9"}
    docs = {i: " ".join(word() for _ in range(200)) for i in range(400)}
    for i in range(60):
        t = items[r.choice(list(items))].split()
        if len(t) > 30:
            t[r.randrange(len(t))] = "another"
        docs[1000 + i] = r.choice([" ", ", ", " \ue000 "]).join(t if i % 2 else [docs[i], *t, "end"])
    d, b = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    made, whole = [], decontaminate.windows
    monkeypatch.setattr(decontaminate, "windows", lambda rows, *a: made.append(rows) or whole(rows, *a))
    got = sorted(map(tuple, decontaminate.contaminated(d, b.filter("item_id < 90")).collect()))
    assert len(got) > 25 and made[-1].count() < 150
    every = sorted(map(tuple, decontaminate.contaminated(d, b).collect()))
    monkeypatch.setattr(decontaminate, "TELLING_WORDS", 0)
    assert sorted(map(tuple, decontaminate.contaminated(d, b.filter("item_id < 90")).collect())) == got and made[-1].count() == len(docs)
    assert sorted(map(tuple, decontaminate.contaminated(d, b).collect())) == every


@pytest.mark.parametrize("seed", range(2))
def test_contamination_against_plain_windows(spark, seed):
    """Random items, their parameters changed or cut, in random documents, against plain Python."""
    r = random.Random(seed)
    pool = "the old man sold walked to market and how many apples left river long went Peter Maria London 3 12 7 450 km hours dollars x2 after before".split()
    items = {i: " ".join(r.choice(pool) for _ in range(r.choice([2, 4, 6, 12, 25]))) for i in range(14)}
    docs = {}
    for d in range(120):
        parts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12)))]
        for i in r.sample(sorted(items), r.randint(0, 2)):
            w = items[i].split()
            swap = {x: r.choice(["5", "88", "Anna", "miles", x]) for x in ("3", "12", "Peter", "Maria", "km")} if r.random() < 0.6 else {}
            w = [swap.get(x, x) if r.random() < 0.97 else r.choice(pool) for x in w]
            parts += [r.choice([" ".join, lambda w: " ".join(w).lower()])(w), r.choice([". ", ", ", " and ", ""])]
        docs[d] = " ".join(parts)
    docs |= {200: None, 201: "", 202: "...", 203: items[0]}
    got = decontaminate.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = brute.contaminated(docs, items, set(decontaminate.UNITS))
    assert len(want) > 20 and {(x["doc_id"], x["item_id"]): pytest.approx(x["coverage"]) for x in got.collect()} == want


def test_contamination_beyond_a_broadcast(spark):
    item = "A train leaves the station at 12 and travels 340 km in 5 hours"
    d = spark.createDataFrame([(1, item), (None, f"x {item.replace('340', '2')}"), (3, "no")], "doc_id long, text string")
    rows, row = common.numbered(d)
    for most in (0, 500_000):
        assert {r["doc_id"] for r in decontaminate.matches(rows, ["doc_id", row], bench(spark, [item]), broadcast_windows=most).collect()} == {1, None}


def test_rows_of_one_id_are_judged_apart(spark):
    item = "What is the name of the river that runs through the old town"
    d = [(1, item, None), (1, "nothing of it", "x"), (None, item, "y"), (None, None, "z"), (1, "nothing of it", "x")]
    left = decontaminate.clean(spark.createDataFrame(d, "doc_id long, text string, item_id string"), bench(spark, [item, item]))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, (d[1], d[3], d[4])))


def test_planted_benchmark_passages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    b = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    want = {(i, k) for i, t in zip(d["doc_id"], d["text"]) for k, x in zip(b["item_id"], b["text"]) if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op5_decontaminate(spark, SF).collect()}
    assert want and want == got


# ---- 6 --------------------------------------------------------------------------------------------------------------


def check_repeats(rows, got, length=100):
    want = brute.removed_bytes([(d, t) for d, t, *_ in rows], length)
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = want[d]
        kept = hashlib.sha256(bytes(x for j, x in enumerate(raw) if j not in gone)).hexdigest()
        assert tuple(got[d]) == (d, len(raw), len(gone), sum(1 for a in gone if a - 1 not in gone), kept)


@pytest.mark.parametrize("share", [0.02, 1e-9, 0.002])
def test_repeats(docs, rows, none, share):
    check_repeats(rows, by_id(suffix.remove_repeats(docs, share=share)))
    assert suffix.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_a_small_alphabet(spark, seed):
    r = random.Random(seed)
    base = "".join(r.choice("ab") for _ in range(700))
    rows = [(i, "".join(base[a : a + r.randint(20, 400)] for a in [r.randint(0, 600) for _ in range(r.randint(1, 4))])) for i in range(25)]
    check_repeats(rows, by_id(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))


def test_repeated_ids(spark):
    d = spark.createDataFrame([(1, "x" * 40 + "abc" * 60), (1, "x" * 40 + "abc" * 60), (None, "abc" * 60)], "doc_id long, text string")
    got = suffix.remove_repeats(d).collect()
    assert len(got) == 3 and sum(r["n_removed"] == r["n_bytes"] for r in got) == 1


def test_merge_of_runs():
    r = random.Random(5)
    keys = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(200)})
    runs = [{} for _ in range(7)]
    for i, k in enumerate(keys * 2):
        r.choice(runs).setdefault(k, (i, 0))
    merged = list(suffix.merge_runs([suffix.open_run(suffix.pack_run(x)) for x in runs]))
    assert [m[1] for m in merged] == sorted(k for x in runs for k in x)
    for before, now in zip(merged, merged[1:]):
        n = 0
        while n < min(len(before[1]), len(now[1])) and before[1][n] == now[1][n]:
            n += 1
        assert now[0] == n


# ---- 7 --------------------------------------------------------------------------------------------------------------


def test_simhash(docs, rows, none):
    got = by_id(simhash.near_duplicates(docs))
    prints = {r[0]: brute.simhash(r[1]) for r in rows}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: format(x, "016x") for d, x in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == brute.link_components(prints)
    apart = by_id(simhash.near_duplicates(docs, least_hot=0))  # hot fingerprints joined apart
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in apart.items()} == {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("seed", "most", "agree", "least_hot"), [(0, 3, None, 0), (1, 3, 2, 10**6), (2, 6, None, 10**6), (3, 6, 3, 0)])
def test_links_of_close_fingerprints(spark, seed, most, agree, least_hot):
    r = random.Random(seed)
    prints = []
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 40])):
            for b in r.sample(range(64), r.randint(0, most)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    d = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    root = {r["node"]: r["root"] for r in graph.components(simhash.links(d, most, agree), least_hot=least_hot).collect()}
    want = brute.link_components(dict(enumerate(prints)), most)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(root.get(s, s), set()).add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(j for j in want if want[j] == c) for c in set(want.values())}


def test_blocks_that_must_agree():
    assert [simhash.needed(n, 3) for n in (0, 1000, 60 << 20, 1 << 27, 5 * 10**10, 10**13)] == [1, 1, 1, 2, 2, 4]
    assert simhash.needed(10**6, 6) == 2 and simhash.needed(5 * 10**10, 6) == 4


def test_no_row_is_lost_by_its_nulls(spark):
    """Rows whose values are the same but for where a null stands are rows each."""
    d = [(1, "one two", None), (1, None, "one two"), (2, "ONE  two", None), (3, None, "x"), (3, None, "x")]
    docs = spark.createDataFrame(d, "doc_id long, text string, note string")
    for one in (simhash.one_of_each, lambda x: simhash.one_of_similar(x, most=6)):
        got = sorted(map(str, map(tuple, one(docs).collect())))
        assert got == sorted(map(str, (d[0], d[1])))


def test_one_of_each(docs, rows):
    keep = {r["doc_id"] for r in simhash.one_of_each(docs.unionByName(docs.limit(5))).collect()}
    assert keep == set(brute.link_components({r[0]: brute.simhash(r[1]) for r in rows}).values())


@pytest.mark.parametrize(("enough", "broadcast_rows", "agree"), [(1, 0, None), (16, 200_000, 3)])
def test_one_of_similar(spark, enough, broadcast_rows, agree):
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, at = {}, 0
    for changes in (0, 1, 2, 4, 8, 14, 20, 30):
        base = [r.choice(words) for _ in range(300)]
        for _ in range(25):
            w = base[:]
            for _ in range(r.randint(0, changes)):
                w[r.randrange(300)] = r.choice(words)
            rows[at] = " ".join(w)
            at += 1
    rows |= {at: None, at + 1: "", at + 2: " \n", at + 3: "a b c", at + 4: "A  b c", at + 5: "a b d"}
    prints = {d: brute.simhash(t) for d, t in rows.items()}
    want = brute.similar_roots(rows)
    assert len(want) > len(set(brute.link_components(prints, 6).values()))  # candidates alone would drop more
    got = simhash.one_of_similar(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), most=6, enough=enough, broadcast_rows=broadcast_rows, agree=agree)
    assert got.columns == ["doc_id", "text"] and sorted(x["doc_id"] for x in got.collect()) == sorted(want)
    assert simhash.one_of_similar(got.limit(0), most=6).count() == 0


def test_a_group_of_near_copies_costs_no_pairs(spark, tmp_path, monkeypatch):
    """Copies of one text with more and fewer words changed: most are candidates of each other, half are similar to none.
    Pairs asked for grow with the group, and no link is lost."""
    r = random.Random(7)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = {}
    for at in range(480):
        w = base[:]
        for _ in range(r.randint(0, 7)):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows[at] = " ".join(w)
    asked, real = [], simhash.stage

    def staged(d, name, *a, **k):
        out = real(d, name, *a, **k)
        if name == "simhash-asked":
            asked.append(out.filter("tested").count())
        return out

    monkeypatch.setattr(simhash, "stage", staged)
    cost = []
    for n in (240, 480):
        part = {k: t for k, t in rows.items() if k < n}
        spark.createDataFrame(list(part.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{n}")
        got = simhash.one_of_similar(spark.read.parquet(f"{tmp_path}/{n}"), most=6, enough=2)
        assert sorted(x["doc_id"] for x in got.collect()) == sorted(brute.similar_roots(part))
        cost.append(sum(asked))
        asked.clear()
    print("pairs asked for", cost)
    assert cost[1] < 3.3 * cost[0] and cost[1] < 20 * 480


def test_near_copies_are_asked_for_a_few_times_each(spark, tmp_path, monkeypatch):
    """With as many pairs a member as the pipeline allows, a group of near copies costs a few pairs a copy in all rounds
    together, and no link is lost."""
    r = random.Random(7)
    base, rows = [f"w{r.randrange(4000)}" for _ in range(150)], {}
    for at in range(300):
        w = base[:]
        for _ in range(r.randint(0, 7)):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows[at] = " ".join(w)
    asked, real = [], simhash.stage

    def staged(d, name, *a, **k):
        out = real(d, name, *a, **k)
        if name == "simhash-asked":
            asked.append(out.filter("tested").count())
        return out

    monkeypatch.setattr(simhash, "stage", staged)
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    got = simhash.one_of_similar(spark.read.parquet(f"{tmp_path}/docs"), most=6)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(brute.similar_roots(rows))
    print("pairs asked for", asked)
    assert sum(asked) < 5 * 300


def test_spanning_pairs_join_what_all_pairs_join():
    """With and without a bucket's own pairs, labels and refusals: pairs given, equal labels and pairs of another bucket
    join what all pairs would, no two given pairs say the same, and a group with nothing left out is not asked again."""
    r = np.random.default_rng(5)
    for n, flips in ((1, 0), (60, 3), (700, 5), (700, 0)):
        group = np.sort(r.integers(0, 3, n))
        fp = np.array([1 << 40, 77, ~np.uint64(5)], np.uint64)[group]
        for _ in range(flips):
            fp = fp ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))
        order = np.lexsort((simhash.gray_rank(fp), group))
        fp, group, label = fp[order], group[order], r.integers(0, max(1, n), n) if n < 700 else np.arange(n)
        for own, keep in ((lambda i, j: i >= 0, None), (lambda i, j: (i + j) % 3 > 0, lambda i, j: (i * j) % 2 == 0)):
            i, j, rest = simhash.spanning_pairs(fp, fp, group, label, 6, 12, 0, own, keep, pairs_at_once=50)
            a, b = np.triu_indices(n, 1)
            near = (group[a] == group[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= 6) & (label[a] != label[b])
            near[near] &= keep is None or keep(a[near], b[near])
            a, b = a[near], b[near]
            same = [np.flatnonzero(np.isin(label, label[k]) & (group == group[k]))[0] for k in range(n)]
            want, got = np.arange(n), np.arange(n)
            for root in (want, got):
                simhash.unite(root, np.arange(n), np.array(same, np.int64))
            sets = len(np.unique(got))
            elsewhere = ~own(a, b)
            simhash.unite(want, a, b)
            simhash.unite(got, i, j)
            assert len(np.unique(got)) == sets - len(i) and own(i, j).all() and (label[i] != label[j]).all()
            simhash.unite(got, a[elsewhere], b[elsewhere])
            assert (got == want).all()
            given = set(zip(i.tolist(), j.tolist()))
            left = {int(group[x]) for x, y, e in zip(a.tolist(), b.tolist(), elsewhere) if not e and (x, y) not in given}
            assert left <= set(rest.tolist())


def test_sketches_refuse_no_similar_pair():
    r = random.Random(3)
    sets = []
    for n in (0, 1, 4, 9, 40, 90, 150, 600, 2500, 20_000):
        base = [r.getrandbits(64) for _ in range(n)]
        for share in (0, 0, 0.02, 0.1, 0.12, 0.3, 1):
            k = int(share * n)
            sets += [base[k:] + [r.getrandbits(64) for _ in range(k)], base[k:]]
    sets = [np.unique(np.array(x, np.uint64)).view(np.int64) for x in sets]
    made = [simhash.sketch(x) for x in sets]
    none = [True, *[False] * (len(sets) - 1)]
    i, j = np.triu_indices(len(sets), 1)
    m = np.array([len(sets[a]) + len(sets[b]) for a, b in zip(i, j)])
    both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)])
    similar = both >= 0.8 * (m - both)
    possible = simhash._possible(pd.Series([None if no else x for no, x in zip(none, made)]), pd.Series([len(x) for x in sets]), 0.8, words_at_once=1000)(i, j)
    assert possible[similar].all() and possible[i == 0].all()
    far = (both < 0.7 * (m - both)) & (i > 0)
    assert far.any() and not possible[far].any()


NAMES = ("__key", "__copies", "__copy", "__bad", "__file", "__at", "__id", "__whole", "__row", "__stays_file", "__stays_at", "__text", "doc_text", "item_id", "digest", "fp", "second", "stays", "place", "h", "salt", "copies", "taken", "src", "upto", "t", "rank", "e")


def test_any_column_may_be_there(spark):
    """Every name that a stage of the pipeline gives a helper, as a column of its input."""
    rows = [(1, "one two three four five six seven", "a"), (2, "ONE two three four five six seven", "a"), (3, None, None), (4, "what is 12 plus 7 apples then", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in NAMES:
        docs = docs.withColumn(c, F.lit("x"))
    items = spark.createDataFrame([(9, "what is 12 plus 7 apples then")], "item_id long, text string")
    ids = lambda d: sorted(r["doc_id"] for r in d.collect())
    for one in (simhash.one_of_each(docs), simhash.one_of_similar(docs, most=6)):
        assert one.columns == docs.columns and ids(one) == [1, 3, 4]
    assert ids(decontaminate.clean(docs, items)) == [1, 2, 3] and decontaminate.clean(docs, items).columns == docs.columns
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= {1, 2, 4}


@pytest.mark.parametrize("agree", [2, 3, 4, 5])
def test_candidates_found_whatever_the_size(spark, agree):
    """For every number of blocks that ``needed`` may ask for: 0.9 or more of the pairs that share 80 % of their shingles,
    by a replay of the buckets over pairs whose texts differ in a few words."""
    r = random.Random(11)
    most, found, total = 6, 0, 0
    while total < 150:
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(60, 400))]
        other = base[:]
        for _ in range(r.randint(1, 8)):
            other[r.randrange(len(other))] = f"w{r.randrange(3000)}"
        a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        if not 0.8 <= len(a & b) / len(a | b) < 1:
            continue
        total += 1
        hashes = [simhash.shingle_hashes(" ".join(w), 3) for w in (base, other)]
        one, two = simhash.fold_bits(hashes), simhash.fold_bits([simhash.remixed(h) for h in hashes])
        apart = [int(one[0] ^ one[1]), int(two[0] ^ two[1])]
        blocks = most + agree
        edges = [64 * i // blocks for i in range(blocks + 1)]
        for d in apart[: simhash.sketches(agree)]:
            shared = sum(not d >> lo & ((1 << hi - lo) - 1) for lo, hi in zip(edges, edges[1:]))
            near = d.bit_count() <= most or d.bit_count() <= simhash.REACH and sum(x.bit_count() for x in apart) <= simhash.BOTH
            if shared >= agree and near:
                found += 1
                break
    print(f"agree {agree}: {found} of {total}")
    assert found >= 0.9 * total


def test_components_of_a_chain(spark):
    e = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = graph.components(e).collect()
    assert len(got) == 61 and {r["root"] for r in got} == {0}


# ---- 8 --------------------------------------------------------------------------------------------------------------


def test_rules(docs, rows, none):
    got = by_id(rules.judge(docs))
    for d, t, *_ in rows:
        c, r = brute.base_counts(t), got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        assert r["base_failed"] == brute.base_failed(c) and not (r["base_failed"] and r["kept"])
    assert rules.judge(none).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    d = [(i, good, "good") for i in range(50)] + [(100 + i, "bad", "bad") for i in range(200)] + [(300, good, "bad"), (301, good, None)]
    got = by_id(rules.judge(spark.createDataFrame(d, "doc_id long, text string, source string")))
    assert got[300]["kept"] is False and got[300]["base_failed"] is False and got[0]["kept"] and got[301]["kept"]


# ---- 9 --------------------------------------------------------------------------------------------------------------


def test_shards(docs, rows, none):
    got = by_id(sharding.shard(docs, shards=4))
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    assert {d: (r["size"], r["text_crc32"]) for d, r in got.items()} == {d: (size[d], brute.crc(t)) for d, t, *_ in rows}
    per, slots = dict.fromkeys(range(4), 0), {s: [] for s in range(4)}
    for d, r in got.items():
        per[r["shard"]] += size[d]
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert max(per.values()) - min(per.values()) <= 2 * max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0


def test_copies_stay_together_and_huge_groups_are_split(spark):
    r = random.Random(2)
    rows = [(i, f"{i} " + "x" * r.randint(50, 100)) for i in range(600)] + [(1000 + i, f"group {i // 3}" + "y" * 40) for i in range(60)] + [(2000 + i, "one text" + "z" * 60) for i in range(400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).toPandas().set_index("doc_id").sort_index()
    small = got.loc[1000:1059]
    assert all(small.loc[1000 + 3 * g : 1002 + 3 * g, "shard"].nunique() == 1 for g in range(20))
    total = got.groupby("shard")["size"].sum()
    assert total.max() - total.min() < 500
    assert got.loc[2000:2399, "shard"].nunique() <= 3


def test_many_copies_of_short_texts_are_cut_by_rows(spark):
    """A third of all rows are one empty text: few bytes, many parts; hot and other copies are told from the rest."""
    rows = [(i, f"{i} " + "x" * 90) for i in range(300)] + [(1000 + i, "") for i in range(200)] + [(2000 + i, f"pair {i // 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(docs, shards=4, parts_a_shard=8).toPandas()
    assert len(got) == 540 and got.groupby("shard")["size"].sum().agg(lambda s: s.max() - s.min()) < 200
    groups = docs.groupBy(F.col("text").alias("gg")).agg(F.count("*").alias("n")).filter("n > 1")
    linked, rest = sharding.linked_and_rest(docs.withColumnRenamed("text", "g"), groups, 20_000)
    assert {r["doc_id"] for r in linked.collect()} == {d for d, _ in rows if d >= 1000}
    assert {r["doc_id"] for r in rest.collect()} == set(range(300))


def test_labels_against_plain_propagation(spark):
    """The same labels as a plain loop over the parts."""
    r = random.Random(4)
    d = []
    for t in range(60):
        for p in range(r.choice([1, 1, 2, 3, 9])):
            d += [(r.randint(1, 30), f"text {t}", p, r.randrange(5)) for _ in range(r.randint(1, 4))]
    d += [(20, "huge", p, r.randrange(5)) for p in range(40)]
    chunked = spark.createDataFrame(d, "size long, g string, part long, label int")
    total = sum(x[0] for x in d)
    h = chunked.select("g", "part", F.xxhash64("g").alias("gh"), F.xxhash64("g", "part").alias("ph")).distinct().collect()
    free = {(x["g"], k): x["f"] for k in range(30) for x in chunked.select("g", F.xxhash64("g", F.lit(k)).alias("f")).distinct().collect()}
    for quota in (total / 5 * 1.1, total / 5):
        spots, left = sharding.propagate(chunked, 5, quota)
        want, room = brute.propagate(d, 5, quota, {x["g"]: x["gh"] for x in h}, {(x["g"], x["part"]): x["ph"] for x in h}, lambda g, k: free[g, k])
        assert {(x["pg"], x["pp"]): x["shard"] for x in spots.collect()} == {k: v for k, v in want.items() if v is not None}
        assert [left[s] for s in range(5)] == pytest.approx(room)


def test_cut_links_fall_and_sizes_stay_even(spark):
    r = random.Random(6)
    texts = [f"{t} " + "x" * r.randint(20, 60) for t in range(150)]
    d = [(i, r.choice(texts[:100]) if i % 2 else f"alone {i}" + "y" * r.randint(10, 60)) for i in range(1500)] + [(5000 + i, "copy " * 9) for i in range(700)]
    docs = spark.createDataFrame(d, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("g", F.lit(1))
    got = sharding.shard(docs, shards=6).toPandas().merge(docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(6)).alias("dealt")).toPandas(), on="doc_id")
    before, after = (sharding.cut_links(spark.createDataFrame(got[["text", c]]), "text", c).head() for c in ("dealt", "shard"))
    huge = got[got["text"] == d[-1][1]].groupby("shard").size()
    assert before["links"] == after["links"] and before["cut"] > 1000 and after["cut"] <= 700 - huge.max() + 30
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 6 and size.max() - size.min() < 0.02 * size.mean() + 2 * got["size"].max()


# ---- 10 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "<|im_end|>", r"<\|x", r"<\\|im_start|>", "a<||>b\n", "%0A%25", "<", "|", r"\<|"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n")) == text + "\n"
    assert chat.parse(chat.render(text, text)[0]) == (text, text)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>"), (1, 2, "assistant", None), (2, 1, None, "x\ny"), (2, 0, "system", ""), (None, None, "user", "lost"), (3, 0, "assistant", "é" * 50000), (1, 1, "user", "tie")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = by_id(chat.read_back(chat.format_log(chat.conversation_events(d))), "conv_id")
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert {c: tuple(r)[1:5] for c, r in got.items()} == {c: brute.chat_digest(t) for c, t in turns.items()}
    assert chat.read_back(chat.format_log(chat.conversation_events(d.limit(0)))).count() == 0


def test_a_streamed_log_says_what_the_messages_say(spark):
    """Deltas, edits, regenerations and deletions fold to the finished messages; ties, nulls, repeats and other columns too."""
    r = random.Random(5)
    texts = [None, "", "x", "é<|im_end|>" * 90, "w " * 9000, "two\nlines"]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(texts) if t % 3 else f"{c} {t} " * r.randint(1, 90), 1, "s", "k", 2) for c in range(12) for t in range(8)]
    rows += rows[:9] + [(None, None, "user", "lost", 1, "s", "k", 2)] * 2 + [(1, None, "user", "a", 1, "s", "k", 2), (1, None, "user", "b", 1, "s", "k", 2)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int, kind string, nth string, way int")
    log = chat.streamed_events(d)
    kinds = {x["kind"]: x["n"] for x in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate", "delete"} and kinds["delta"] > len(rows) / 5
    turns = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is None, x[1] or 0, x[2] or "", x[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    got = by_id(chat.read_back(chat.format_log(log)), "conv_id")
    assert {c: tuple(x)[1:5] for c, x in got.items()} == {c: brute.chat_digest(t) for c, t in turns.items()}
    assert chat.streamed_events(d.limit(0)).count() == 0


def test_events_fold_into_messages(spark):
    e = [(1, 0, 0, "message", "user", "q"), (1, 1, 1, "message", "assistant", "a"), (1, 1, 2, "delta", "assistant", "b"), (1, 1, 3, "regenerate", "assistant", ""), (1, 1, 4, "delta", "assistant", "c"), (1, 1, 5, "delta", "assistant", "d"), (1, 2, 6, "message", "user", "x"), (1, 2, 7, "edit", "user", "y"), (1, 3, 8, "message", "user", "gone"), (1, 3, 9, "delete", "user", None), (1, 4, 10, "delta", "assistant", "late")]
    d = spark.createDataFrame(e, "conv_id long, turn long, seq long, kind string, role string, text string")
    got = [chat.parse(r["formatted"]) for r in chat.format_log(d).orderBy("piece").collect()]
    assert got == [("user", "q"), ("assistant", "cd"), ("user", "y"), ("assistant", "late")]


# ---- helpers, pipeline ----------------------------------------------------------------------------------------------


def test_running_total(spark):
    d = spark.createDataFrame([(i % 3 or None, i, i % 5) for i in range(200)], "g int, i long, v int").withColumn("h", F.xxhash64("i"))
    got = common.running_total(d, ["g"], "h", ["i"], "v", "upto", rank="r").collect()
    for g in (None, 1, 2):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["h"])
        at = 0
        for k, r in enumerate(mine):
            at += r["v"]
            assert (r["upto"], r["r"]) == (at, k + 1)


def stages(spark, docs, sf):
    import corpus_pipeline as p

    tables = [docs]
    for _, f in p.STAGES:
        tables.append(common.stage(f(spark, tables[-1], sf), "test"))
    return tables


def test_pipeline(spark):
    """Each stage on what the one before kept, against plain Python."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    assert [n for n, _ in p.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "token ids"]
    docs = common.read(spark, SF, "documents")
    good, single, clean, mixed, out = stages(spark, docs, SF)[1:]
    assert all(t.columns == docs.columns for t in (good, single, clean, mixed))
    labels = common.read(spark, SF, "labels")
    model = quality.train(docs, labels, ~queries.held_out())
    plain = [(w, tuple((n.removeprefix("__s_"), left, t) for n, left, t in rule)) for w, rule in model.rules]
    kept = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect() if brute.quality_score(r["text"], model.bias, plain) >= 0.7}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert np.mean([(d in kept) == (q == 1) for d, q in marked.items()]) > 0.9
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(kept)
    stay = brute.similar_roots({d: t for d, (t, _) in kept.items()}, most=p.NEAR_BITS)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(stay)
    items = {r["item_id"]: r["text"] for r in common.read(spark, SF, "benchmark").collect()}
    bad = {d for d, _ in brute.contaminated({d: kept[d][0] for d in stay}, items, set(decontaminate.UNITS))}
    stay -= bad
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(stay)
    h = {r["doc_id"]: r["h"] for r in clean.select("doc_id", F.xxhash64(F.lit(42), "doc_id", "text").alias("h")).collect()}
    ids = sorted(stay)
    line = [(kept[d][1], (h[d], d), len(brute.words(kept[d][0]))) for d in ids]
    sizes = {}
    for s, _, n in line:
        sizes[s] = sizes.get(s, 0) + n
    taken = brute.mix_taken(line, brute.mix_targets(sizes), sum(sizes.values()))
    want = sorted(d for d, n in zip(ids, taken) for _ in range(n))
    assert sorted(r["doc_id"] for r in mixed.collect()) == want
    t, at, lines = Tokenizer.from_file(queries.vocabulary()), 0, []
    for d in want:
        raw = np.array([*t.encode(kept[d][0], add_special_tokens=False).ids, 0], "<u4")
        lines.append((d, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert sorted(tuple(r) for r in out.collect()) == lines == sorted(tuple(r) for r in p.run(spark, SF).collect())


def test_pipeline_cases(spark, docs, none):
    """Nulls, empty and repeated rows, clashing columns and empty tables through every stage."""
    more = spark.createDataFrame([(None, None, None, None, None, "1", None, None, None, None, None)] * 2 + [(9000, "", None, "a", 0, None, 2, "k", "s", "f", "p"), (9000, None, "", "a", 0, None, 2, "k", "s", "f", "p")], SCHEMA)
    good, single, clean, mixed, out = stages(spark, docs.unionByName(docs.limit(5)).unionByName(more), SF)[1:]
    for before, after in ((docs, good), (good, single), (single, clean), (clean, mixed)):
        assert after.columns == docs.columns
    assert good.count() >= single.count() >= clean.count() and out.count() == mixed.count()
    assert [t.count() for t in stages(spark, none, SF)] == [0] * 6
