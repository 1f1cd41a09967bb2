"""Operators 2, 3, 8, 9 and 10 against brute force, held-out accuracy and edge cases."""

import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from pitwall.llm import langid, quality, queries, token_count, token_output, toxicity
from tests.llm.conftest import DOCS, EMPTY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, name, sf=DOCS):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- token counts


def greedy(word: bytes, pieces: set[bytes]) -> int:
    n, at = 0, 0
    while at < len(word):
        k = next(k for k in range(len(word) - at, 0, -1) if word[at:at + k] in pieces)
        at, n = at + k, n + 1
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(3)
    pieces = [bytes([b]) for b in range(256)] + [b" a", b" ab", b"abcd", b"bcx", b"cde", b"abab", b"ababc", b" abcde", "é".encode()]
    pieces += ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))).encode() for _ in range(60)]
    a = token_count.PieceAutomaton(pieces)
    words = ["".join(rng.choice("abcdex") for _ in range(rng.randint(1, 25))).encode() for _ in range(400)] + ["éé".encode(), b"a" * 500]
    buf = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - np.array([len(w) for w in words])
    assert a.count(buf, start, end).tolist() == [greedy(b" " + w, set(pieces)) for w in words]


def test_automaton_needs_every_byte():
    with pytest.raises(ValueError):
        token_count.PieceAutomaton([b"a"])


def test_token_counts_query(spark):
    with open(RANKS, "rb") as f:
        pieces = {base64.b64decode(x.split()[0]) for x in f}
    got = {r.doc_id: r for r in queries.op2_token_counts(spark, DOCS).collect()}
    docs = table(spark, "documents").collect()
    assert len(got) == len(docs)
    for r in docs[:40]:
        ws = WORD.findall(r.text or "")
        assert got[r.doc_id].n_words == len(ws)
        assert got[r.doc_id].n_tokens == sum(greedy(b" " + w.encode(), pieces) for w in ws)


def test_token_counts_edges(spark, make):
    rows = token_count.token_counts(make(EMPTY).withColumnRenamed("source", "n_tokens"), RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows if r.doc_id != None)[:4] == [(1, 0), (2, 0), (3, 0), (5, 1)]  # noqa: E711
    assert len(rows) == 6
    assert token_count.token_counts(make([]), RANKS).count() == 0


# --- token output


def test_token_output_round_trip(spark, tmp_dir):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(queries.op3_token_output(spark, DOCS).collect())
    at = 0
    for r, d in zip(got, sorted(table(spark, "documents").select("doc_id", "text").collect())):
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_parts_encode_like_whole_texts():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, rng = Tokenizer.from_file(path), random.Random(5)
    texts = ["".join(rng.choice(["a", "b", "it's", " ", "  ", "\n", " \n", "é", " ", " ", "1", "<|endoftext|>", "!", ".", ",", ".\n", "É", "...", "²", "'", "\t", "日"]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    enc = token_output.CachedEncoder(path)
    enc.spaced.keep = enc.first.keep = 50
    for i in range(0, len(texts), 80):
        assert enc.encode(texts[i:i + 80]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts[i:i + 80]]


def test_token_output_edges(spark, make, tmp_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    root = token_output.write_tokens(make(EMPTY), path, f"file://{tmp_dir}/tokens", shards=3)
    rows = sorted(token_output.read_tokens(spark, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 5]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])])[:-1].tolist()
    assert rows[1].n_tokens == 1 and rows[1].ids_crc32 == zlib.crc32(b"\0\0\0\0")
    assert token_output.read_tokens(spark, token_output.write_tokens(make([]), path, f"file://{tmp_dir}/none")).count() == 0


# --- quality rules


def plain_base(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else __import__("collections").Counter(grams)
    rep = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def coverage(text, k):
    ws = WORD.findall(text or "")
    seen, mark = set(), set()
    for i in range(len(ws) - k + 1):
        g = tuple(ws[i:i + k])
        if g in seen:
            mark |= set(range(i, i + k))
        seen.add(g)
    return sum(len(ws[i]) for i in mark) / max(1, sum(map(len, ws)))


def test_quality_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op9_quality_rules(spark, DOCS).collect()}
    for d in table(spark, "documents").collect():
        r, x = got[d.doc_id], plain_base(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == x
        assert r.base_failed == (x[0] < 50 or 100 * x[4] > 50 * x[0])
        assert np.allclose(r.dup_ngram_share, [coverage(d.text, k) for k in (5, 7, 10)])
        assert r.kept <= (not r.base_failed)


def test_quality_made_texts(spark, make):
    line = "one two three four five six seven eight nine ten"
    texts = ["\n".join([line] * 9), "a b a b a b c", "x\r\nx\nx", "\n\n", "  é#  é#\n é# é#", "a\nb\na\n\na", "word " * 20000]
    rows = quality.quality_rules(make(list(enumerate(texts)) + EMPTY)).collect()
    for r in rows[:len(texts)]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(texts[r.doc_id])
    assert len(rows) == len(texts) + 6 and not any(r.kept for r in rows)
    assert quality.quality_rules(make([])).count() == 0


# --- language


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, "documents", sf).collect()}
    rows = queries.op10_language_id(spark, sf).collect()
    out = [r for r in rows if r.held_out and docs[r.doc_id].lang and len(docs[r.doc_id].text or "") > 40]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(docs)
    assert np.mean([r.rejected for r in out]) < 0.03


def test_language_edges(spark, make):
    text = {"aa": "the cat and the dog went on to the house ", "bb": "der hund und die katze gehen in das haus "}
    train = [(i, text[k] * (1 + i % 3), k) for i in range(60) for k in text]
    docs = make(train + [(901, None, "aa"), (902, "", "aa"), (903, "12 + 34 !!", "aa"), (904, "the house", None), (None, "das haus", None)])
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3
    assert got[904].lang_pred == "aa" and got[None].lang_pred == "bb" and not got[None].held_out
    assert langid.fit(make([(1, "abc", None)])) is None
    assert langid.predict(make([(1, "abc")]), None).first().lang_pred == "und"
    assert langid.predict(make([]), model).count() == 0
    far = langid.predict(make([(1, "zqxj wvkp qqzx jjkw xzqv " * 40)]), model).first()
    assert far.rejected
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id in (901, 902, 903)").count() == 0


# --- toxicity


def edit_distance(a, b):
    """Letters put in, left out or replaced, or neighbours swapped."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_trie_search_equals_brute_force():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(80)]
    lex = toxicity.Lexicon(terms)
    for _ in range(1500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
        near = sorted((d, t) for t in lex.terms if (d := edit_distance(w, t)) <= lex.edits(t) and (not d or lex.accepts(w, t)))
        assert lex.search(w) == ((near[0][1], near[0][0]) if near else None)
        if near and near[0][0]:
            assert lex.may_match(w)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in table(spark, "labels", sf).collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == table(spark, "documents", sf).count() and all(0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted for r in out if toxic[r.doc_id]]) > 0.8
    assert np.mean([r.predicted for r in out if not toxic[r.doc_id]]) < 0.02


def test_toxicity_edges(spark, make):
    bad = "you are a horrible scoundrel indeed number"
    docs = make([(i, f"{bad} {i}" if i % 2 else f"a fine day it is number {i}") for i in range(200)] + [(300, "you are a sckoundrel"), (301, 'they said "scoundrel" to me')] + [(None, None), (400, ""), (400, "")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1), (400, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert "scoundrel" in model.terms and got[300].n_misspelled == 1 and got[301].n_quoted == 1
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[400].predicted == 0 and 0 <= got[None].score <= 1
    none = toxicity.fit(docs, labels.filter("false"))
    assert toxicity.score(docs, none).filter("predicted = 1").count() == 0
    assert toxicity.score(make([]), model).count() == 0


def test_every_plain_term_is_found_with_an_edit():
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(900)})
    matcher = toxicity.Matcher({t: 1.0 for t in terms})
    wrong = {t: t[:4] + "x" + t[5:] for t in terms}
    matcher.look(set(wrong.values()))
    assert len(terms) > 800 and all(matcher.hit[w] == (t, 1) for t, w in wrong.items())


def test_short_terms_swaps_and_signs():
    matcher = toxicity.Matcher({t: 0.5 for t in ("idiot", "scum", "moron", "worthless", "abc", "stup*")}, {"morin"})
    same = {"idoit": "idiot", "mroon": "moron", "scm": "scum", "scumm": "scum", "id1ot": "idiot", "i*diot": "idiot", "wrothless": "worthless", "worhtless": "worthless", "xworthless": "worthless"}
    other = {"xdiot", "adiot", "abd", "morin", "iditoo", "wrothlses", "", "mo"}
    matcher.look(set(same) | other | {"stupidly", "idiot"})
    assert {w: matcher.hit.get(w) for w in same} == {w: (t, 1) for w, t in same.items()}
    assert not other & matcher.hit.keys() and matcher.hit["stupidly"] == ("stup*", 0) and matcher.hit["idiot"] == ("idiot", 0)
    x, n = matcher.features(["You ID1OT and i*diot!", 'she said "scum" twice', "scum", "fine"], 3)
    assert n.tolist() == [[0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]] and (x[:3, :4].sum(1) > 0).all() and not x[3, :5].any()


def test_misspelt_and_quoted_insults_carry_weight(spark, make):
    """Insults used are toxic, also misspelt ones; quoted ones are mostly not: each kind of hit gets a weight of its own."""
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choice(["garden", "house", "river", "cloud", "table", "music"]) + str(rng.choice("xyz")) for _ in range(12))
    insults = ["scoundrel", "villain", "moron"]

    def wrong():
        w = rng.choice(insults)
        k = rng.randrange(1, len(w))
        return w[:k] + rng.choice("qwyk7") + w[k + 1:]

    rows, labels = [], []
    for i in range(1800):
        kind = i % 18
        say = f"you {rng.choice(insults)}" if kind < 4 else f"you {wrong()}" if kind < 6 else f'they said "{rng.choice(insults)}" to you' if kind == 6 else \
            f'they said "{wrong()}" to you' if kind == 7 else "they said hello to you"
        rows.append((i, f"{filler()} {say} {filler()}"))
        labels.append((i, 1, int(kind < 6 or (kind in (6, 7) and rng.random() < 0.25))))
    docs = make(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(insults) <= set(model.terms)
    exact, misspelt, quoted, both = model.weights[:4]
    assert exact > quoted + 0.3 and misspelt > both + 0.3 and misspelt > 0.5
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted for i in held if i % 18 < 6]) > 0.95 and np.mean([got[i].predicted for i in held if i % 18 > 7]) == 0
    assert np.mean([got[i].score for i in held if i % 18 in (4, 5)]) > np.mean([got[i].score for i in held if i % 18 == 7]) + 0.2


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5000)], "doc_id long, quality int, toxic int")
    assert 350 < toxicity.sample(labels, 500).count() < 650 and toxicity.sample(labels, 10**6).count() == labels.filter("crc32(cast(doc_id as string)) % 4 != 2").count()


def test_toxicity_long_text_and_column_names(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + "scoundrel", 5, "x"), (2, None, 6, "y")], "doc_id long, text string, h long, toxic string")
    model = toxicity.Model({"scoundrel": 1.0}, np.array([3.0, 2, 1, 1, 0, -1]), toxicity.Fit())
    got = {r.doc_id: r.n_hits for r in toxicity.score(docs, model).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")).terms == []


def test_copies_of_a_text_are_one_witness(spark, make):
    copied = "ordinary words about gardens and weather"
    docs = make([(i, copied) for i in range(60)] + [(100 + i, f"you scoundrel number {i}") for i in range(60)] + [(200 + i, f"a fine day it is number {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, 1, int(i < 200)) for i in range(260)], "doc_id long, quality int, toxic int")
    terms = toxicity.fit(docs, labels).terms
    assert "scoundrel" in terms and not set(terms) & toxicity.units(copied)


def test_rare_insults_stay_beside_many_ordinary_words(spark, make):
    letters = "abcdefghijklmnopqrstuvwxyz"
    # 110,000 ordinary words (too short for stems) in eight toxic and sixteen clean texts, an insult in seven toxic ones
    everyday = " ".join([a + b + c + d for a in letters for b in letters for c in letters for d in letters][:110_000])
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][:24]
    docs = make([(k, f"{everyday} {'zzscoundrel' if i < 7 else ''} {i}") for i, k in enumerate(ids)])
    labels = spark.createDataFrame([(k, 1, int(i < 8)) for i, k in enumerate(ids)], "doc_id long, quality int, toxic int")
    assert "zzscoundrel" in toxicity.fit(docs, labels).terms


def test_stored_alone_leaves_its_result_only(spark):
    import os
    from pitwall.llm import common as C

    def build():
        a = C.stored(spark.range(5), "step-a")
        b = C.stored_alone(lambda: C.stored(a.selectExpr("id * 2 as id"), "step-b").filter("id > 0"), "step-c")
        paths.extend(x.inputFiles()[0].rsplit("/", 1)[0] for x in (a, b))
        return b.join(a, "id")

    paths = []
    out = C.stored_alone(build, "result")
    assert sorted(r.id for r in out.collect()) == [2, 4]
    assert not any(os.path.exists(p.replace("file://", "")) for p in paths)
    assert os.path.exists(out.inputFiles()[0].replace("file://", ""))
