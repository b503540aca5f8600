"""Operators against brute force, the libraries and planted cases; nulls, empty and long texts, ties, clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagemill.llm import byte_bpe, chat_format, decontaminate, language_id, license_scan, near_duplicates, quality_classifier, quality_rules, toxicity
from passagemill.llm.components import connected_components
from passagemill.llm.queries import queries, tokenizer_path
from passagemill.llm.shared import split_by_bitmap
from passagemill.llm.token_counts import count_tokens

BITS = ["a", "don't", "'s", "'re", "''", " ", "  ", "\n", "\t ", "1", "²", "é", "日本", "<|endoftext|>", "<|endoftext|", "!", "...", "the ", "Ünder", " 's", "\r\n", "😀", "\x1c", "x'ves"]


def odd_texts(n=150):
    rng = random.Random(3)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "   ", "ab" * 4000 + " " + "é" * 300, "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(odd_texts())] + [(None, None, None, None), (7, "again", "x", 0.0), (7, "again", "x", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def library():
    return Tokenizer.from_file(tokenizer_path())


def test_token_counts(spark, odd, none):
    t = library()
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    for entries in (1 << 16, 3):  # a full table, and one that nearly everything misses
        got = count_tokens(odd, tokenizer_path(), entries=entries).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert count_tokens(none, tokenizer_path()).count() == 0


def test_bpe(spark, odd, none):
    t = library()
    for r in byte_bpe.encode(odd.where("doc_id <> 7"), tokenizer_path()).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids
    back = byte_bpe.decode(byte_bpe.encode(odd, tokenizer_path()), tokenizer_path())
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    for r in byte_bpe.round_trip(odd.where("doc_id < 7"), tokenizer_path()).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert byte_bpe.round_trip(none, tokenizer_path()).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i, _ in docs}


def near_docs():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 150))]
        for _ in range(8):  # a lineage: each text edits the one before it
            docs.append((n, " ".join(base)))
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocab)
            n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, "Two words"), (n + 3, "two  WORDS"), (n + 4, docs[0][1].upper()), (n + 5, "x " * 4000)]
    return docs


@pytest.mark.parametrize("cell", [512, 7])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(near_duplicates, "CELL_TEXTS", cell)  # 7: components are cut into blocks
    docs = near_docs()
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, component_id int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(d).collect()}
    assert got == brute_components(docs)


def test_near_duplicates_edges(spark, none):
    assert near_duplicates.near_duplicates(none).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates.near_duplicates(d).collect())
    assert got == [(0, None, True), (0, None, True), (1, 1, True), (1, 1, True)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (3, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_bitmap(spark):
    ids = spark.createDataFrame([(i * 7,) for i in range(300)], "id long")
    rows = spark.range(3000).withColumn("at", F.lit("clash")).unionByName(spark.createDataFrame([(None, None)], "id long, at string"))
    likely, others = split_by_bitmap(rows, "id", ids, "id")
    passed = {r.id for r in likely.collect()}
    assert {i * 7 for i in range(300)} <= passed and len(passed) < 600 and likely.columns == rows.columns
    assert likely.count() + others.count() == 3001
    likely, others = split_by_bitmap(rows, "id", ids.limit(0), "id")
    assert likely.count() == 0 and others.count() == 3001


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = split(text), set(), []
    for i, t in items:
        iw = split(t)
        m = min(13, len(iw))
        windows = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)} if m else set()
        at = [k for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in windows] if m else []
        hit |= {p for k in at for p in range(k, k + m)}
        found += [str(i)] * bool(at)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, none, limit):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([40, 13, 14, 30, 5, 1, 8])] + [(7, ""), (8, None)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)]
    for k in range(40, 70):
        i, t = rng.choice(items[:4])
        w = t.split()
        a = rng.randrange(max(1, len(w) - 12))
        docs.append((k, (text(rng.randint(0, 200)) + " " + ", ".join(w[a : a + rng.randint(11, 16)]).upper() + " " + text(9)).strip()))
    docs += [(70, None), (71, ""), (72, "v1 " * 500)]
    d = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(d, b, broadcast_words=limit).collect()}
    assert got == {i: brute_hits(t, items) for i, t in docs}
    assert decontaminate.decontaminate(none, b, broadcast_words=limit).count() == 0


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeats = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeats) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeats), failed


def test_quality_rules(spark, none):
    docs = [(i, t) for i, t in enumerate(odd_texts(40))] + [(900, None), (901, "a b c " * 40 + "\n" + "x | y # \n" * 30), (902, " ".join(f"w{i}" for i in range(80)))]
    d = spark.createDataFrame([(i, t, None if i % 5 == 0 else f"h{i % 3}", "x") for i, t in docs], "doc_id long, text string, source string, n_words string")
    got = {r.doc_id: tuple(r)[1:] for r in quality_rules.quality_rules(d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute_rules(t) for i, t in docs}
    assert quality_rules.quality_rules(none).count() == 0


def test_host_verdict(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if i % 10 == 0 else bad, "spam") for i in range(100)] + [(100 + i, bad if i % 10 == 0 else good, "fine") for i in range(100)] + [(500, good, None), (501, good, "new")]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not kept[0] and kept[101] and kept[500] and kept[501]


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok \\0 \\1 <\\| \\"
    rows = [(1, 0, "system", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "user", "q\nx"), (1, 4, "assistant", ""), (1, 5, "assistant", "two"), (1, 6, "user", "tail"), (2, 0, "user", "alone"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (None, 0, "odd\nrole", "t")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_start", F.lit("clash"))
    made = chat_format.format_conversations(d)
    replies = [r for r in made.where("conv_id = 1").orderBy("example").collect()]
    assert len(replies) == 4 and replies[0].text[replies[0].loss_start : replies[0].loss_end] != "" and replies[3].loss_start == replies[3].loss_end
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r[2], r[3] or "") for r in rows[:7]] and back[1].loss == [hard, "two"]
    assert [tuple(t) for t in back[3].turns] == [("assistant", "a"), ("assistant", "b")] and back[2].loss == [] and back[None].turns[0].role == "odd\nrole"
    assert back[1].formatted_chars == sum(len(r.text) for r in replies)
    assert chat_format.read_back(chat_format.format_conversations(d.limit(0))).count() == 0


def test_license(spark, none):
    long = license_scan.STATEMENTS[3][1]
    cut = " ".join(long.split()[:-3])  # over four fifths of it
    rows = [(1, "x y z.\nReleased under the MIT\nLicense. more"), (2, "word " * 900 + long.upper() + " end" * 700), (3, "nothing here under the sun license"), (4, None), (5, ""), (6, cut), (7, "all rights, reserved")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license int")
    got = sorted((r.doc_id, r.license, r.first_word) for r in license_scan.license_scan(d).collect())
    assert got == [(1, "mit", 3), (2, "mit", 900), (6, "mit", 0), (7, "all-rights-reserved", 0)]
    assert license_scan.license_scan(none).count() == 0 and license_scan.bands_for(0.5, 1e-6) == 20


def test_languages(spark, none):
    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    langs = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["ção", "nh", "ou"]}
    rows = [(i, make(langs[x]), x) for i, x in enumerate(["aa", "bb", "cc"] * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(d.where("doc_id < 60"))
    ask = d.where("doc_id >= 60").unionByName(spark.createDataFrame([(900, None, None), (901, "12 !?", None), (902, "", None), (903, "schung " * 50_000, "bb")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in language_id.predict(ask.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[60:]) and got[903].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language_id.predict(ask, language_id.learn(none)).where("lang_pred <> 'und'").count() == 0


def labelled(spark, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_learns_folds_and_excuses(spark, none):
    rng = random.Random(4)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    make = lambda *more: " ".join([*(rng.choice(plain) for _ in range(40)), *more])
    rows = [(i, make("zlurk", "zlurk")) for i in range(40)] + [(i, make()) for i in range(40, 300)] + [(i, make("kind", "zlurk")) for i in range(300, 304)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i < 40)) for i, _ in rows], "doc_id long, toxic int")
    lex = toxicity.learn(d, y)
    assert lex.weights and any("kind zlurk" in e for e in lex.exceptions)
    ask = spark.createDataFrame([(1, make("zlurk", "ZLURK")), (2, make("zIurk".replace("I", "l"), "zlurк")), (3, make("kind", "zlurk")), (4, make()), (5, None), (6, ""), (7, make() * 200)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(ask.withColumn("score", F.lit("x")), lex).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    empty = toxicity.learn(none, y)
    assert toxicity.score(ask, empty).where("predicted = 1").count() == 0


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    made = queries()
    for name, col, least in (("op4_quality_classifier", "quality", 0.93), ("op9_toxicity", "toxic", 0.9)):
        rows = made[name](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
        assert sum(r[col] == r.predicted for r in rows) / len(rows) >= least, name
        assert all(0 <= r.score <= 1 for r in rows)
    rows = made["op7_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97


def test_quality_classifier_edges(spark, none):
    d = spark.createDataFrame([(1, "fine words in a row here"), (2, "bad $$$ %%% $$$"), (3, None), (4, "")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.score(d, quality_classifier.learn(d, y)).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert quality_classifier.score(none, quality_classifier.learn(none, y)).count() == 0
