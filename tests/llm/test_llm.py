"""Operators of the llm subpackage: brute force, exact round trips, held-out accuracy; nulls, repeats, empty and long texts."""

import itertools
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from conftest import rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loomdex.llm import bpe, encodings, leaks, pages, survivors  # noqa: E402

VOCABULARY = bpe.DEFAULT_VOCABULARY
DIR = "/root/testdata/sf0.001"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


# ---- problem 6


def brute_groups(files):
    group = {f[0]: f[0] for f in files}
    changed = True
    while changed:
        changed = False
        for a in files:
            for b in files:
                if a[1] is not None and a[1] == b[1] and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3])) and group[b[0]] < group[a[0]]:
                    group[a[0]] = group[b[0]]
                    changed = True
    return group


def test_linked_groups_and_survivors_against_brute_force(spark):
    rng = random.Random(1)
    files = [(i, rng.choice(["uti", "utc", None]), rng.choice([None, f"c{rng.randint(0, 40)}"]), rng.choice([None, f"s{rng.randint(0, 60)}"]), rng.choice([1, 2, None]),
              rng.choice([None, 10, 20]), rng.choice([None, 5]), rng.choice([None, "k"])) for i in range(150)]
    df = spark.createDataFrame(files, "id long, ext string, a string, b string, precedence int, mtime int, size long, kind string").withColumn("class", F.lit(0)).withColumn("root", F.lit(0))
    groups = survivors.linked_groups(df, "id", "ext", "a", "b")
    brute = brute_groups(files)
    want = {f[0]: brute[f[0]] for f in files if f[1] is not None}
    assert dict(rows(groups)) == want
    got = {r["group_id"]: r for r in survivors.rank_survivors(df.join(groups, "id"), "group_id", "id", survivors._order(), {"keep_id": None, "size_id": F.col("size"), "kind_id": F.col("kind")}).collect()}
    by = {}
    for f in files:
        if f[1] is not None:
            by.setdefault(want[f[0]], []).append(f)
    order = lambda f: (f[4] is None, f[4] or 0, f[5] is None, -(f[5] or 0), f[0])
    first = lambda fs: min(fs, key=order)[0] if fs else None
    assert {g: (r["keep_id"], r["size_id"], r["kind_id"]) for g, r in got.items()} == {
        g: (first(fs), first([f for f in fs if f[6] is not None]), first([f for f in fs if f[7] is not None])) for g, fs in by.items() if len(fs) > 1
    }
    assert survivors.linked_groups(df.limit(0), "id", "ext", "a", "b").count() == 0


def test_survivors_limit_each_task_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 1, 1)], "id long, group_id long, precedence int, mtime int")
    plan = survivors.rank_survivors(df, "group_id", "id", survivors._order(), {"keep_id": None})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@needs_data
def test_p6_against_sql(spark):
    import duckdb

    from loomdex.llm import registry

    c = duckdb.connect()
    for t in ("files", "sources"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in registry.SQL.items():
        q = c.sql(sql)
        assert rows(registry.QUERIES[name](spark, DIR).select(*q.columns)) == sorted(map(tuple, q.fetchall()), key=repr)


# ---- problem 7


@needs_vocabulary
def test_encoding_equals_the_public_libraries(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(2)
    bits = ["a", "th", "ing", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "łó", "ß", "²", "中文", "\U0001f600", "\u0301", "'s", "'S", "<|endoftext|>", "12", "...", "\x00", "\u200b", "Wilaerin", "aaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += [None, "", " ", "a" * 60_000, "".join(rng.choice("abcdeéz ") for _ in range(60_000))]
    df = spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    got = dict(rows(bpe.encode_texts(df, "doc_id", "text")))
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert [got[i] for i in range(len(texts))] == [w.ids for w in want]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_speculation_and_exact_merging_agree():
    v = bpe.Vocabulary(VOCABULARY)
    rng = random.Random(3)
    tokens = list(v.tokens)
    e = bpe.Encoder(v)
    words = [b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 4))).decode("utf-8", "ignore") for _ in range(3000)]
    words = list(dict.fromkeys(w for w in words if w))
    e.learn(words)
    assert [e.words[w] for w in words] == [v.exact(w.encode()) for w in words]
    assert 0 < e.failed < len(words)


# ---- problem 8


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(15)] + ["naïve", "Straße", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, ""), (0, items[0][1])]
    docs = []
    for i in range(400):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            w = rng.choice(items[:30])[1].split()
            n = rng.randint(8, 16)
            at = rng.randint(0, max(0, len(w) - n))
            body[3:3] = w[at : at + n]
        docs.append((i, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "z " * 50_000 + items[1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    t = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, x in docs:
        w = leaks.plain_words(x or "")
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for j, y in items:
            v = leaks.plain_words(y or "")
            if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)):
                want.add((i, j))
    assert set(rows(leaks.leaks(d, t))) == want and len(want) > 50
    assert rows(leaks.leaks(d, t, most=100)) == sorted(want, key=repr)  # several tables, items that go on in the next
    assert leaks.leaks(d, t.limit(0)).count() == 0 and leaks.leaks(d.limit(0), t).count() == 0


def test_leaks_of_very_many_items(spark):
    word = lambda i: f"w{i * 7919 % 99_991}"
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.concat(F.lit("w"), ((F.col("id") * 12 + k) * 7919 % 99_991).cast("string"))), " ").alias("text"))
    docs = [(j, "x " + " ".join(word(j * 12 + k) for k in range(12)) + " y") for j in range(0, 100_000, 5000)] + [(7, "x " + " ".join(word(7 * 12 + k) for k in range(11)))]
    got = rows(leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, most=40_000).where("doc_id = item_id"))
    assert sorted(got) == [(j, j) for j in range(0, 100_000, 5000)]


@pytest.mark.parametrize("garb", [
    lambda s: s.upper(), lambda s: s.replace(" ", "   \n> "), lambda s: s.replace("a", "á").replace("e", "e\u200b"), lambda s: s.replace(" w", " <b>w</b>").replace("keeper", "<i>kee</i>per"),
    lambda s: "".join(f"&#{ord(c)};" if c in "kw" else c for c in s), lambda s: s.replace("without", "with-\nout"), lambda s: s.replace(" ", ", “"), lambda s: s.replace("o", "o\xad"),
    lambda s: s.replace("Keeper", "[url=http://x.y/z]Keeper[/url]"), lambda s: s.replace(" that", " [that](http://q.example/a_b)"),
])
def test_leaks_through_disguise(garb):
    item = "Keeper Fenulrin wrote that a lantern without bards remains cracked until somebody from Unaoholt"
    engine = leaks.WuManber([(1, leaks.plain_words(item))])
    assert engine.find(leaks.plain_words("before " + garb(item) + " after")) == {1}
    short = " ".join(item.split()[:11])
    assert engine.find(leaks.plain_words("before " + garb(short) + " after")) == set()
    assert engine.find(leaks.plain_words("house" + " ".join(item.split()[:12]))) == set()


# ---- problem 9

PROSE = ["The wardens of the old mill say that nobody has seen the lantern since the winter.", "If you keep the rope until dawn, you will find the market empty and the door open.",
         "Der Schmied hat den Schlüssel vor dem Tor verloren und sucht ihn seit fünf Tagen.", "It is said that the keeper of the tower trades in copper, but the sailors know better."]


def make_page(rng, spam):
    phrases = [f"{a} {b}" for a in ("cheap", "golden", "epic", "best", "free") for b in ("items", "loot", "maps", "codes")]
    some = rng.sample(phrases, 4)
    kinds = {
        "words": lambda: " ".join(rng.choice(some) for _ in range(60)),
        "links": lambda: "\n".join(f"https://www.{rng.choice(some).replace(' ', '-')}.example/{rng.randint(1, 999)}" for _ in range(15)),
        "tags": lambda: "Tags: " + "; ".join(rng.choice(phrases) for _ in range(30)),
        "hashes": lambda: " ".join("#" + rng.choice(phrases).replace(" ", "") for _ in range(30)),
        "goods": lambda: "\n".join(f"{rng.choice(phrases).title()} +{rng.randint(0, 5)} NEW {rng.randint(1, 90)}.99 gold SKU-{rng.randint(1000, 9999)}" for _ in range(12)),
    }
    tell = ["".join(rng.choice(PROSE) + " " for _ in range(rng.randint(2, 5))).strip() for _ in range(rng.randint(2, 5))]
    if spam:
        return rng.choice(PROSE) + "\n\n" + kinds[rng.choice(list(kinds))]() if rng.random() < 0.5 else kinds[rng.choice(list(kinds))]()
    return "\n\n".join(rng.choice([tell, [*tell, tell[0]], [*tell, "Tags: mill, rope"], [*tell, "See https://www.mill.example/a for that."]]))


def test_pages_held_out_accuracy(spark):
    rng = random.Random(5)
    docs = [(i, make_page(rng, i % 4 == 0)) for i in range(600)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, PROSE[0] + (" " + PROSE[1]) * 2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("prose", F.lit("clash"))
    shares = {r["doc_id"]: r for r in pages.line_shares(d).collect()}
    assert len(shares) == len(docs) and shares[1000]["lines"] == shares[1001]["lines"] == shares[1002]["chars"] == 0
    flagged = {i for i, r in shares.items() if r["chars"] - r["prose"] > pages.SHARE * r["chars"]}
    want = {i for i in range(600) if i % 4 == 0}
    assert len(flagged & want) / len(want) >= 0.95 and len(flagged - want) <= 6
    assert 1003 not in flagged
    assert pages.line_shares(d.limit(0)).count() == 0


def test_pages_count_every_word(spark):
    said = [f"The old {' '.join(f'w{i}x' for i in range(k, k + 100))} is here." for k in range(0, 60_000, 100)]
    docs = [(i, x) for i, x in enumerate(said * 3)] + [(-1, "The old rare1 rare2 rare3 is here."), (-2, "The old rare1 rare2 rare3 is here.")]
    model = pages.train(pages.described(spark.createDataFrame(docs, "doc_id long, text string")), rounds=0)
    words = [f"w{i}x" for i in range(60_000)] + ["the", "old", "is", "here"]
    ids = pages.word_ids(pa.array(words))
    assert set(model.keys) == set(ids.tolist()) and len(set(ids.tolist())) == len(words)
    size, distinct, k = 1802 * 4 + 180_000 + 6, 60_007, len(pages.STATES)
    only = np.eye(k)[pages.PROSE]
    logs = np.log((3 * only + 0.5) / (size * only + 0.5 * distinct + 1))
    assert np.allclose(model.words[model.keys.get_loc(ids[59_999])], logs - logs.mean())


def test_viterbi_of_a_batch_against_every_path():
    rng = np.random.default_rng(7)
    k = len(pages.STATES)
    model = pages.Model(rng.integers(0, 9, (pages.MARKS, 16, k)), rng.integers(9, 99, k), rng.random(k), rng.random((k, k)), np.arange(50), rng.integers(0, 9, (50, k)), np.full(k, 300.0), 50)
    lens = [3, 1, 4, 2]
    n = sum(lens)
    sizes = rng.integers(0, 20, n)
    x = pages.Lines(np.repeat(np.arange(4), lens), rng.integers(0, 3, (n, pages.MARKS)).astype(np.int8), np.full(n, -1, np.int8), np.ones(n, np.int64), sizes, rng.integers(0, 60, sizes.sum()))
    emit, got = model.emissions(x), model.decode(x)
    for d in range(4):
        at = np.flatnonzero(x.doc == d)
        cost = lambda p, at=at: model.first[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(emit[i, s] for i, s in zip(at, p, strict=True))
        assert np.isclose(cost(tuple(got[at])), max(map(cost, itertools.product(range(k), repeat=len(at)))))
    assert len(model.decode(pages.describe(pa.array([None, "", " \n"])))) == 0


def test_descriptions_do_not_depend_on_the_batch():
    texts = ["Get rope, get rope.\nhttps://a.example/b c\n\nTags: mill; rope", None, "<p>One &amp; two</p><a href='//x.example/y'>there</a>", "It's the mill's rope.\u2028It's the mill's rope.", "void main() {", "AB-1234 Rope #one #two"]
    whole = pages.describe(pa.array(texts))
    for i, text in enumerate(texts):
        one, at = pages.describe(pa.array([text])), whole.doc == i
        assert np.array_equal(one.form, whole.form[at]) and np.array_equal(one.sure, whole.sure[at]) and np.array_equal(one.chars, whole.chars[at]) and np.array_equal(one.sizes, whole.sizes[at])
    assert whole.sure.tolist() == [-1, pages.LINKS, pages.TAGS, -1, -1, -1, -1, pages.CODE, pages.TAGS] or len(whole.sure) == 9


# ---- problem 2

CLEAN = ["Strażnik zgubił pęknięty pierścień w piwnicy młyna.", "Późną jesienią sprzedał źródło za kołczan.", "Die Wächter hüten den Schlüssel für fünf Jahre.", "Der süße Käfig öffnet die Tür zum Gewölbe.",
         "Où est passée la clé enchantée du château ?", "Les bûcherons se méfient d’un écu trouvé à l’église.", "El baúl frágil apareció en el jardín del señor.", "¿Dónde está el bastón? La niña robó el puñal.",
         "Старый фонарь открывает дверь в подземелье.", "Никто не помнит, почему серебряный ключ лежит у колодца.", "The lantern of the keeper is broken and the bandits wait.", "“You again?” asks the smith — he’s tired."]
WAYS = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp850")]


def garble(s, meant, assumed):
    try:
        t = s.encode(meant).decode(assumed)
    except UnicodeError:
        return None
    return t if t != s else None


def test_garbled_texts_are_found_and_restored(spark):
    rng = random.Random(6)
    clean = [s for s in CLEAN for _ in range(60)] + ["Selôvale", "Pelãnost", "Čáry a kouzla", "Storage 12 m³ ± ½", "§4 ¶2 of the Charter", "LIÇÃO DE MAGIA Nº 3", "１２３"] * 5
    bad = [(t, s) for s in CLEAN for m, a in WAYS if (t := garble(s, m, a))]
    bad += [(t2, s) for s in CLEAN[:6] if (t := garble(s, "utf-8", "cp1252")) and (t2 := garble(t, "utf-8", "cp1252"))]
    lost = ["Le ma\ufffdtre d\ufffdarmes pr\ufffdf\ufffdre"]
    data = [(i, x, "ok") for i, x in enumerate(clean)] + [(10_000 + i, x, "bad") for i, (x, _) in enumerate(bad)] + [(20_000, lost[0], "bad"), (20_001, None, "ok"), (20_002, "", "ok"), (20_003, CLEAN[2] * 3000, "ok")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "id long, text string, mapping_ string")
    got = {r["id"]: r for r in encodings.garbled(df, "text", encodings.count_pairs(df, "text")).collect()}
    wrong = [r for r in got.values() if r["mapping_"] == "ok"]
    assert not wrong, [r["text"][:60] for r in wrong]
    found = [i for i in range(len(bad)) if 10_000 + i in got]
    assert len(found) >= 0.95 * len(bad)
    right = [i for i in found if got[10_000 + i]["restored"] == bad[i][1]]
    assert len(right) >= 0.85 * len(found)
    assert 20_000 in got and got[20_000]["restored"] is None
    assert encodings.garbled(df.limit(0), "text", encodings.count_pairs(df.limit(0), "text")).count() == 0


@pytest.mark.parametrize("hot", [CLEAN[8], CLEAN[0], CLEAN[10]])
def test_a_text_that_fills_the_corpus_garbles_no_other(spark, hot):
    names = ["Îsle of Ÿrs", "© Guild of ¾ Measures — a", "Cliché naïveté — façade", "Storage 12 m³ ± ½ — b", "BOTÃO À VENDA — c"]
    texts = [(s,) for s in CLEAN for _ in range(30)] + [(n + x,) for n in names for x in ("", " d", " — e") for _ in range(3)]
    bad = garble(CLEAN[2], "utf-8", "cp1252")
    df = spark.createDataFrame([*texts, (bad,)], "text string").unionByName(spark.range(20_000).select(F.lit(hot).alias("text")))
    model = encodings.count_pairs(df, "text")
    got = {r["text"] for r in encodings.garbled(df, "text", model).collect()}
    assert got == {bad}
    assert model.total < 60_000  # 20,000 copies count as 431


def test_marginals_hold_all_pairs_and_rare_pairs_are_unseen():
    model = encodings.PairModel({("a", "b"): 9}, {"a": 10, "c": 5}, {"b": 12, "d": 3})
    assert model.total == 15 and model.first["a"] == 10 and model.information("c", "d") == -4.0


@needs_data
def test_every_query_runs_on_empty_tables(spark, tmp_path):
    from loomdex.llm import registry
    from loomdex.plans.session import TABLES

    for t in TABLES:
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in registry.QUERIES.items():
        if name != "p7_ids" or os.path.exists(VOCABULARY):
            assert query(spark, str(tmp_path)).count() == 0, name
