"""The text operators against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assayflow.llm import chat, decontam, jaccard, langid, linededup, spm, warc
from assayflow.llm import shingles as shingles_of
from assayflow.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, k int, h1 string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---------------------------------------------------------------- chat


def chats(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "a" * 900), (1, 2, "assistant", "b " * 700), (1, 3, "user", "c"),
        (1, 4, "assistant", "d<|turn|>\\ \\n </s>"), (1, 5, "user", "e" * 9000), (1, 6, "assistant", "😀\n<|end|>\n" * 40),
        (2, 0, "user", None), (2, 1, None, "x"), (2, 1, "assistant", ""), (3, 5, "user", "only"), (None, 0, "user", "n"),
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 5, "user", "only"),
        (4, 0, "us\ner", "\\|<\\|<<SYS>>"), (4, 1, "assistant", "\\n\\\\"),
    ]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} " * (i % 37)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("counted", [False, True])
def test_chat(spark, counted):
    rows, df = chats(spark)
    df = df.selectExpr("*", "1 as window", "'x' as formatted", "text as `Loss`")  # clashing names are ignored
    rules = chat.ChatWindows(max_tokens=300, history_tokens=80)
    pieces = spm.Pieces.load(TOKENIZER)
    windows = chat.format_chats(df, rules, pieces=pieces if counted else None)
    found = chat.read_back(windows.repartition(7)).collect()
    assert len(found) == len({r[0] for r in rows})
    got = {r.conv_id: r for r in found}
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    every = windows.collect()
    assert all(w.tokens <= 300 or w.n_new == 1 for w in every)
    tables = spm.Tables(pieces)
    assert all(len(spm.encode(tables, w.formatted)) <= w.tokens for w in every)
    assert got[1].n_windows > 2 and got[9].n_windows > 5
    later = [w for w in every if w.conv_id == 1 and w.window > 0]
    assert all(w.formatted.startswith("<|turn|>system\nBe brief.<|end|>") for w in later)
    assert any(w.n_repeated > 0 for w in every if w.conv_id == 9)


def test_escape():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<", "|", "[", "INST]", "/", "s>", "n", "\n", "<|end|>", "<<SYS>>", "a"]) for _ in range(8))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not re.search(r"<\||</?s>|\[/?INST\]|<<SYS>>", safe)


# ---------------------------------------------------------------- language ID


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = langid.learn_profiles(docs)
    got = langid.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (None, "the thing and the other"), (4, "a")])
    out = langid.identify(odd, profiles).collect()
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 6
    assert langid.keep_identified(odd, profiles).columns == odd.columns
    none = langid.learn_profiles(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_language_id_rejects(spark, sf):
    """Gibberish and an unlearned language go; documents stay, and so do short passages of them."""
    import base64

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = langid.learn_profiles(docs)
    rng = random.Random(8)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(n)) for n in (40, 500)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    bad = [*letters, base64.b64encode(rng.randbytes(2250)).decode(), polish, "123 !?", None]
    texts = [r.text for r in docs.select("text").collect() if r.text and any(c.isalpha() for c in r.text)]
    short = [" ".join(t.split()[:n]) for t in texts for n in (1, 3, 8)]
    good = [*texts, *[t for t in short if any(c.isalpha() for c in t)], "the", "the house", "de la casa"]
    rows = list(enumerate([*bad, *good]))
    got = {r.doc_id for r in langid.keep_identified(frame(spark, rows), profiles).collect()}
    assert got == set(range(len(bad), len(rows)))


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update(w)
        padded = f" {w} "
        for n in (2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def plain_profiles(rows, sample, size=langid.PROFILE):
    """rows: doc_id, text, lang of the training documents; sample: those learned from."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if (i, lang) in sample:
            counts[lang].update(plain_grams(text))
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:size]] for lang, c in counts.items()}


def plain_language(text, profiles, size=langid.PROFILE):
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    own = [g for g, _ in sorted(plain_grams(text).items(), key=lambda x: (-x[1], code(x[0])))[:size]]
    if not own:
        return "und", 0.0
    far = {}
    for lang, ranked in profiles.items():
        place = {g: k for k, g in enumerate(ranked)}
        far[lang] = sum(min(size, abs(place[g] - k)) if g in place else size for k, g in enumerate(own))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(own))


@pytest.mark.parametrize("train_docs", [langid.TRAIN_DOCS, 7])
def test_language_id_against_plain_python(spark, sf, train_docs, monkeypatch):
    """op4_language_id, profiles and predictions, on all documents."""
    import zlib

    from assayflow.llm import queries

    learn = langid.learn_profiles
    monkeypatch.setattr(queries, "learn_profiles", lambda docs: learn(docs, train_docs=train_docs))
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "lang", "xxhash64(doc_id) h").collect()
    training = [r for r in docs if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    sample = set()
    for lang in {r.lang for r in training}:
        ids = sorted({(r.h, r.doc_id) for r in training if r.lang == lang})[:train_docs]
        sample |= {(i, lang) for _, i in ids}
    profiles = plain_profiles([(r.doc_id, r.text, r.lang) for r in training], sample)
    got = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = plain_language(r.text, profiles)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-9
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_id_odd_rows(spark):
    """Ties go to the first language by name; an empty table, very long texts and clashing columns are fine."""
    train = [(i, t, lang) for i in range(40) for t, lang in (("uno dos tres", "b"), ("uno dos tres", "a"), ("xx yy zz", "c"))]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string").selectExpr("*", "1 as h", "2 as place", "'q' as score")
    profiles = langid.learn_profiles(docs)
    assert profiles.langs == ["a", "b", "c"]
    rows = frame(spark, [(1, "dos uno"), (2, "xx " * 500_000), (3, "漢字")])
    got = {r.doc_id: r for r in langid.identify(rows, profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["a", "c", "a"] and got[3].score == 0
    none = spark.createDataFrame([], rows.schema)
    assert langid.identify(none, profiles).count() == langid.keep_identified(none, profiles).count() == 0
    kept = langid.keep_identified(rows, profiles, langs=("c",), label_col="h1").collect()
    assert [(r.doc_id, r.h1) for r in kept] == [(2, "c")]


def test_ranking_is_rank_order():
    text = "Anna anno, Ñandú 7 a"
    count = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        count.update(w)
        padded = f" {w} "
        for n in (2, 3):
            count.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    assert langid.ranking(text).tolist() == [code(g) for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))]
    p = langid.Profiles({"x": [code(g) for g in ("a", "n", " a")], "y": [code("q")]}, 5)
    far = p.distances(langid.np.array([code("n"), code("a"), code("zz")]))
    assert far.tolist() == [1 + 1 + 5, 15]


# ---------------------------------------------------------------- line dedup


def slow_line_dedup(rows):
    first, out = {}, {}
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0])
    for i, t in rows:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(words(x) for x in w):
                first.setdefault(w, (i, p))
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            at = first.get(tuple(lines[p : p + 3]))
            if at and at != (i, p):
                gone |= {x for x in range(p, p + 3) if not (at[0] == i and at[1] <= x < at[1] + 3)}
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(f"line {rng.randrange(25)}" for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(200, ""), (201, "\n\n\n\n"), (202, "a\nb"), (203, "x\nx\nx\nx\nx\nx"), (204, "x\nx\nx"), (205, "é\n😀\n\nq")]
    want = slow_line_dedup(rows)
    more = [*rows, (300, None), (205, "é\n😀\n\nq")]
    got = linededup.dedup_documents(frame(spark, more).repartition(3), report=True).collect()
    assert len(got) == len(more)
    for r in got:
        if r.text is None:
            assert (r.doc_id, r.n_lines, r.n_removed) == (300, 0, 0)
        else:
            assert (r.n_lines, r.n_removed, r.text) == want[r.doc_id], r
        assert (r.k, r.h1) == (1, "x")


# ---------------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The model file with its type changed to unigram, whose library search is a Viterbi search too."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(TOKENIZER, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p, score in zip(model.pieces, spm.Pieces.load(TOKENIZER).score, strict=True):
        p.score = score
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path)), spm.Tables(spm.Pieces.load(str(path)))


ODD_TEXTS = ["", " ", "  two  spaces ", "a", "\n", "\n\nx \n y", "😀 é ñ 漢字", "tab\there", "x" * 300, "ab" * 500, "\x00\x01", "<s>"]


def test_sentencepiece_against_library(unigram, spark, sf):
    library, tables = unigram
    texts = [t for t in ODD_TEXTS if "😀" not in t and "x" * 300 != t]
    for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(150).collect():
        texts += [t[i : i + 300] for i in range(0, min(len(t), 1500), 300)]
    for t in texts:
        assert spm.encode(tables, t) == library.encode(t), t


def test_sentencepiece_round_trip_and_stream(unigram):
    rng = random.Random(3)
    for tables in (unigram[1], spm.Tables(spm.Pieces.load(TOKENIZER))):
        texts = [*ODD_TEXTS, "▁", "a▁ ▁b", " ▁ "]
        texts += ["".join(rng.choice(" \nabeinrst▁é😀the") for _ in range(rng.randrange(60))) for _ in range(300)]
        for t in texts:
            ids = spm.encode(tables, t)
            assert spm.decode(tables, ids) == t
            cuts = sorted(rng.randrange(len(t) + 1) for _ in range(4))
            chunks = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
            assert list(spm.encode_stream(tables, chunks)) == ids


def test_sentencepiece_commits_early(unigram):
    search, given, most = spm.Viterbi(unigram[1]), 0, 0
    for _ in range(300):
        given += len(search.feed("▁the▁thing"))
        most = max(most, len(search.text))
    assert given and most < 200


def test_sentencepiece_ids_come_from_the_streaming_search(unigram, monkeypatch):
    """All ids of a text are what feed() and end() give; longer words only pass through the window."""
    _, tables = unigram
    tables.known.clear()
    given = []
    feed, end = spm.Viterbi.feed, spm.Viterbi.end
    monkeypatch.setattr(spm.Viterbi, "feed", lambda self, more: given.append(x := feed(self, more)) or x)
    monkeypatch.setattr(spm.Viterbi, "end", lambda self: given.append(x := end(self)) or x)
    text = "every word once: " + "ab" * 300 + "thething" * 40
    assert spm.encode(tables, text) == [i for x in given for i in x]
    assert sum(map(len, given[:-1])) > 100


def test_sentencepiece_documents(spark):
    pieces = spm.Pieces.load(TOKENIZER)
    docs = frame(spark, [(1, None), (2, ""), (3, "Hello  world\n▁"), (3, "Hello  world\n▁"), (None, "z" * 5000)])
    rows = spm.encode_documents(docs, pieces)
    got = rows.collect()
    assert [(r.n_ids, r.ids) for r in got if r.doc_id in (1, 2)] == [(0, None), (0, [])]
    assert all(r.round_trip for r in got)
    back = [r.text for r in spm.decode_documents(rows, pieces).collect()]
    assert sorted(back, key=str) == sorted((r.text for r in docs.collect()), key=str)


# ---------------------------------------------------------------- decontamination


UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def plain(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", regex.sub(UNSPACED, r" \1 ", (text or "").lower())) if w]


def slow_overlaps(docs, items):
    out = set()
    for i, t in docs:
        d = plain(t)
        for j, u in items:
            g = plain(u)
            size, least = (13, 11) if len(g) >= 13 else (len(g), len(g) - (len(g) >= 7))
            if g and any(
                sum(a == b for a, b in zip(d[p : p + size], g[q : q + size], strict=True)) >= least
                for q in range(len(g) - size + 1)
                for p in range(len(d) - size + 1)
            ):
                out.add((i, j))
    return out


def test_masks_miss_nothing():
    from itertools import combinations

    for gone in combinations(range(decontam.SPAN), decontam.MISSES):
        assert any(
            not any(p + o in gone for o in m) for m in decontam.MASKS for p in range(decontam.SPAN - m[-1])
        ), gone


@pytest.mark.parametrize("block, passes", [(decontam.BLOCK, decontam.PASSES), (60, 100), (60, 0)])
def test_decontamination(spark, block, passes):
    rng = random.Random(11)
    items = [(j, " ".join(some_words(rng, rng.choice([3, 5, 6, 8, 9, 12, 13, 20, 45])))) for j in range(25)]
    items += [(50, None), (51, ""), (52, "Same, SAME same same same same same"), (53, "漢字は語を分けない"), (54, "only"), (54, "only")]
    docs = []
    for i in range(60):
        body = some_words(rng, 40)
        part = plain(rng.choice(items[:25])[1])
        part = part[: rng.choice([10, 13, 15, 50])]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            if part:
                part[rng.randrange(len(part))] = "changed"
        docs.append((i, " ".join([*body[:20], *part, *body[20:]]).upper()))
    docs += [(90, None), (91, ""), (92, "same " * 30), (92, "w1"), (None, items[8][1] + " " + items[7][1])]
    docs += [(93, "x漢字は語を分けるない 漢字が語を分けない"), (94, "漢字漢字"), (95, "the only one"), (95, "the only one")]
    got = decontam.find_overlaps(
        frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block=block, passes=passes
    )
    assert {r.n_hits for r in got.collect() if (r.doc_id, r.item_id) == (95, 54)} == {2}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == slow_overlaps(docs, items)
    assert got.count() > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    left = decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == ["doc_id", "text", "k", "h1"]
    hit = {t for i, t in docs for _ in [0] if slow_overlaps([(i, t)], items)}
    assert sorted(map(str, (r.text for r in left.collect()))) == sorted(str(t) for _, t in docs if t not in hit)


def test_short_items(spark):
    """Items of fewer than 13 tokens: one substitution from seven tokens on, none below; min_item leaves items out."""
    items = spark.createDataFrame([(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (1, 3, 6, 7, 12)], "item_id long, text string")
    docs = []
    for n in (1, 3, 6, 7, 12):
        own = [f"i{n}w{k}" for k in range(n)]
        docs.append((100 * n, " ".join(["a", *own, "b"])))
        docs += [(100 * n + 1 + k, " ".join(["a", *own[:k], "z", *own[k + 1 :], "b"])) for k in range(n)]
        docs.append((100 * n + 50, " ".join(["a", "z", *own[1:-1], "z", "b"])))
    got = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(frame(spark, docs), items).collect()}
    assert got == {(100 * n, n) for n in (1, 3, 6, 7, 12)} | {(100 * n + 1 + k, n) for n in (7, 12) for k in range(n)}
    assert {j for _, j in ((r.doc_id, r.item_id) for r in decontam.find_overlaps(frame(spark, docs), items, min_item=5).collect())} == {6, 7, 12}


def test_long_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT", 64)
    rng = random.Random(2)
    item = some_words(rng, 400, 10_000)
    docs = [(p, " ".join(["x", *item[p : p + 13], "y"])) for p in range(0, 388)]
    got = decontam.find_overlaps(frame(spark, docs), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert got.count() == len(docs)


# ---------------------------------------------------------------- n-gram Jaccard join


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def slow_components(rows):
    rows = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = rows[a][1], rows[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    return Counter((i, len(s), min(least[find(a)], default=None) if s else i) for a, (i, s) in enumerate(rows))


def near_copies(rng, groups=12, size=14):
    rows = []
    for g in range(groups):
        base = some_words(rng, rng.choice([4, 6, 30, 60, 120]), 5000)
        common = "the very same closing words stand below all of these texts here".split()
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join([*copy, *(common if g % 2 else [])])))
    return rows


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(random.Random(block))
    # a chain whose ends don't link, one-word texts, null, empty, repeated rows, a null id
    chain = [f"c{i}" for i in range(104)]
    rows += [(1000 + s, " ".join(chain[s : s + 64])) for s in range(0, 41, 5)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "oNE"), (2005, "a b c d"), (2005, "a b c d"), (None, "One")]
    got = jaccard.similarity_components(frame(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == slow_components(rows)


def test_jaccard_opens_blocks(spark, monkeypatch):
    """Groups that the first round leaves apart are found through the matrix."""
    none = "a bigint, b bigint, ga bigint, gb bigint, na bigint, nb bigint"
    monkeypatch.setattr(jaccard, "star_pairs", lambda rows, percent, seed: spark.createDataFrame([], none))
    rows = near_copies(random.Random(7), 8, 10)
    assert Counter(map(tuple, jaccard.similarity_components(frame(spark, rows)).collect())) == slow_components(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_jaccard_first_shared_token_lies_in_reach(percent):
    """Linked sets have a first shared token that both prefixes hold and that the bound of sizes and places lets
    through; its size buckets are neighbours."""
    rng = random.Random(percent)
    order = np.arange(400)
    links = 0
    for _ in range(20_000):
        one = rng.sample(range(400), rng.randrange(1, 40))
        two = [x for x in one if rng.random() < 0.9] + rng.sample(range(400), rng.randrange(0, 6))
        x, y = sorted(set(one)), sorted(set(two))
        both = set(x) & set(y)
        if not y or 100 * len(both) < percent * len({*x, *y}):
            continue
        links += 1
        t = min(both)
        p, q = x.index(t), y.index(t)
        assert t in jaccard.prefix(np.array(x), order[:0], order[:0], percent) and t in jaccard.prefix(np.array(y), order[:0], order[:0], percent)
        u, v = 100 * len(x) - (100 + percent) * p, 100 * len(y) - (100 + percent) * q
        assert u >= percent * len(y) and v >= percent * len(x)
        s, z = (math.floor(math.log(len(w)) / math.log(100.001 / percent)) for w in (x, y))
        assert abs(s - z) <= 1
    assert links > 500


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_jaccard_least_shared_between(spark, percent):
    """The bound over a range of sizes is the least over each size in it."""
    import pandas as pd

    def slow(n, x):
        return max(1, -(-percent * (n + x) // (100 + percent)) - -(-max(n, x) * percent // 100) + 1)

    rows = []
    for n in [*range(1, 40), 100, 101, 255, 599]:
        low, high = -(-n * percent // 100), n * 100 // percent
        for n1 in range(low, high + 1):
            least = slow(n, n1)
            for n2 in range(n1, min(high, n1 + 60) + 1):
                least = min(least, slow(n, n2))
                rows.append((n, n1, n2, least))
    n, n1, n2 = (jaccard.F.col(c) for c in ("n", "n1", "n2"))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["n", "n1", "n2", "least"]))
    assert df.where(jaccard.least_shared_between(n, n1, n2, percent) != jaccard.F.col("least")).count() == 0


def test_jaccard_keeps_what_can_meet(spark, tmp_path):
    """One class of 13 tokens may meet one of 14 by its second token, but not by its third."""
    rows = [(5, 1, 13, 1), (5, 2, 14, 1), (6, 1, 13, 2), (6, 2, 14, 1), (7, 1, 13, 0), (7, 3, 40, 0)]
    df = spark.createDataFrame(rows, "t long, c long, n long, p long")
    kept = jaccard.able_to_meet(df, 80).select("t", "c").collect()
    assert sorted(map(tuple, kept)) == [(5, 1), (5, 2), (6, 2)]  # a bucket's bound holds the row itself
    grouped = jaccard.able_to_meet(df, 80).withColumn("g", jaccard.F.col("c"))
    assert [tuple(r) for r in jaccard.met_blocks(jaccard.grouped_rows(grouped, f"file://{tmp_path}"), 80).collect()] == [(1, 13, 2, 0)]


def test_jaccard_many_copies_of_an_absent_text(spark):
    """Versions of one text that isn't there itself, some linked only through others, and some in no link."""
    rng = random.Random(3)
    base = some_words(rng, 150, 5000)
    rows = []
    for i in range(160):
        copy = list(base)
        for j in rng.sample(range(150), rng.randrange(1, 8)):
            copy[j] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = jaccard.similarity_components(frame(spark, rows).repartition(5)).collect()
    assert Counter(map(tuple, got)) == slow_components(rows)


def test_jaccard_word_hashes(spark):
    """Long words in an order for which sums of powers modulo 2**64 agree are told apart; words don't depend on
    what is around them, and very long texts are read whole."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    assert Counter(map(tuple, jaccard.similarity_components(frame(spark, [(1, one), (2, two)])).collect())) == {(1, 1, 1): 1, (2, 1, 2): 1}
    rng = random.Random(4)
    parts = ["x" * rng.randrange(1, 600) + str(rng.randrange(50)) for _ in range(300)] + [one[:256], two[:256], "É" * 7, "É" * 8]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(40)] + ["\t".join(parts * 60)]
    known = {}
    for text, h in zip(texts, shingles_of.text_words(pa.array(texts)), strict=True):
        assert len(h) == len(words(text))
        for w, x in zip(words(text), h.tolist(), strict=True):
            assert known.setdefault(w.lower(), x) == x
    assert len(set(known.values())) == len(known)


def test_jaccard_equal_class_hashes(spark, tmp_path):
    """Classes that share half of their hash get ids of their own."""
    df = spark.createDataFrame([(1, 5, 6), (2, 5, 7), (3, 5, 6), (4, 8, 6), (5, None, None)], "doc_id long, c long, c2 long")
    got = {r["doc_id"]: r["c"] for r in jaccard.told_apart(df, f"file://{tmp_path}")(df).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and got[5] is None


# ---------------------------------------------------------------- WARC


def test_warc(spark, tmp_path):
    rng = random.Random(9)
    htmls = [f"<html><p>{' '.join(some_words(rng, 200))}</p></html>" for _ in range(60)] + [None, "", "é😀"]
    rows = [(i, f"http://x/{i}\n", rng.choice(htmls), "extra") for i in range(300)] + [(7, None, "a", "extra"), (7, None, "a", "extra")]
    rows.append((None, "u", "no id", "extra"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(df, f"file://{tmp_path}/a")
    got = warc.read_archives(spark, f"file://{tmp_path}/a").collect()
    last = defaultdict(int)
    for i, _, h, _ in rows:
        if i is not None:
            last[h or ""] = max(last[h or ""], i)
    want = Counter()
    for i, _, h, _ in rows:
        data, best = (h or "").encode(), last.get(h or "")
        revisit = best is not None and i != best
        want[(i, len(data), warc.digest_of(data), "revisit" if revisit else "response", best if revisit else None)] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.export_archives(spark, f"file://{tmp_path}/a", str(tmp_path / "files")) == len(list((tmp_path / "files").iterdir()))
    for file in (tmp_path / "files").iterdir():
        assert file.read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little")
    none = spark.createDataFrame([], df.schema)
    warc.write_archives(none, f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_warc_few_records_and_long_ones(spark, tmp_path):
    """Four pages are too few to train on, and still have a dictionary frame; a payload larger than an archive is whole."""
    big = "".join(random.Random(1).choices("abc <>é", k=warc.ARCHIVE_BYTES))
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(["", "a", big, big + "x"])], "page_id long, url string, html string")
    warc.write_archives(df.where("page_id < 2").coalesce(1), f"file://{tmp_path}/few")
    (row,) = spark.read.parquet(f"file://{tmp_path}/few").collect()
    assert row.content[:4] == (0x184D2A5D).to_bytes(4, "little")
    kinds = [warc.parse_record(x)[0]["WARC-Type"] for x in warc.read_archive(bytes(row.content))]
    assert kinds == ["warcinfo", "response", "response"]
    warc.write_archives(df, f"file://{tmp_path}/long")
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, f"file://{tmp_path}/long").collect()}
    assert got == {r.page_id: (len(r.html.encode()), warc.digest_of(r.html.encode())) for r in df.collect()}


def test_warc_revisit_of_another_payload_fails(spark, tmp_path):
    writer = warc.ArchiveWriter("x", "2000-01-01T00:00:00Z")
    writer.add(warc.record(1, "u", b"one", None, "2000-01-01T00:00:00Z"))
    writer.add(warc.record(2, "u", b"two", 1, "2000-01-01T00:00:00Z"))
    spark.createDataFrame([("x", writer.close())], warc.ARCHIVES).write.parquet(f"file://{tmp_path}/bad")
    with pytest.raises(Exception, match="no response for the revisit of page 2"):
        warc.read_archives(spark, f"file://{tmp_path}/bad").collect()


# ---------------------------------------------------------------- empty tables, pipeline


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    assert linededup.dedup_documents(none).count() == 0
    assert decontam.find_overlaps(none, items).count() == 0
    assert decontam.find_overlaps(frame(spark, [(1, "a b c d e f")]), items).count() == 0
    assert jaccard.similarity_components(none).count() == 0
    assert spm.encode_documents(none, spm.Pieces.load(TOKENIZER)).count() == 0
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]  # none of these scores too low, see test_language_id_rejects
    cut = slow_line_dedup(docs)
    docs = [(i, cut[i][2]) for i, _ in docs if cut[i][2]]
    stay = {i for i, n, c in slow_components(docs) if i == c}
    docs = [(i, t) for i, t in docs if i in stay]
    short = [(i, " ".join(plain(t))) for i, t in docs]
    grams = defaultdict(set)
    for j, u in items:
        w = plain(u)
        for k in range(len(w) - 3):
            grams[tuple(w[k : k + 4])].add(j)
    gone = set()
    for i, t in short:
        w = t.split(" ")
        near = {j for k in range(len(w) - 3) for j in grams.get(tuple(w[k : k + 4]), ())}
        if near and slow_overlaps([(i, t)], [x for x in items if x[0] in near]):
            gone.add(i)
    tables = spm.Tables(spm.Pieces.load(TOKENIZER))
    want = {i: spm.encode(tables, t) for i, t in docs if i not in gone}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert gone and got == want


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)


def test_pipeline_keeps_one_row_of_a_group(spark, sf):
    import corpus_pipeline

    w, v = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, w), (None, w), (5, w), (5, v), (7, v + " x"), (9, v), (9, v), (11, None), (11, None), (12, ""), (None, "alone here"), (None, "alone here")]
    got = corpus_pipeline.near_duplicates(spark, documents(spark, rows).repartition(3), sf)
    assert got.columns == [x.split()[0] for x in DOCUMENTS.split(", ")]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, w), (5, v), (11, None), (11, None), (12, ""), (None, "alone here")])
    # Rows of one id and text that differ elsewhere are one group as well; further columns stay.
    more = documents(spark, [(9, v), (9, v)]).selectExpr("*", "rand() as row_hash", "map(1, 2) as m", "1 as k")
    one = corpus_pipeline.near_duplicates(spark, more, sf)
    assert one.columns == more.columns and one.count() == 1


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Nulls in any column, empty texts, repeated rows, further columns, and an empty table, in each stage."""
    import corpus_pipeline

    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(12).collect()]
    rows = [(None, None), (1, None), (2, ""), (3, " \n"), (None, prose[0]), (4, prose[1]), (4, prose[1]), *enumerate(prose, 10)]
    docs = documents(spark, rows).selectExpr("*", "1 as k", "'x' as h1", "2 as g", "null as lines")
    docs = docs.union(docs.limit(1).selectExpr("doc_id", "text", "null", "null", "null", "null", "null", "null", "null"))
    none = spark.createDataFrame([], DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        out = stage(spark, docs, sf)
        n = out.count()
        assert 0 < n <= docs.count()
        if name != "sentencepiece":
            assert out.columns == docs.columns and stage(spark, none, sf).columns == none.columns
    kept = corpus_pipeline.language_id(spark, docs, sf).collect()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in kept) and {r.lang for r in kept} <= {"en", "de", "fr", "es"}
    assert corpus_pipeline.line_dedup(spark, docs.drop("n_chars"), sf).count() > 0


def test_word_hashes(monkeypatch):
    import pyarrow as pa

    from assayflow.llm import shingles as sh

    monkeypatch.setattr(sh, "PIECE", 64)
    rng = random.Random(4)
    texts = [None, "", " ", "a", "A b\tC\x0bd\n", "x" * 500 + " y", "é\xa0É ß", " ".join(some_words(rng, 300))]
    texts += ["".join(rng.choice("ab \n\x1f") for _ in range(rng.randrange(90))) for _ in range(200)]
    col = pa.array(texts).slice(1)
    seen: dict = {}
    for text, h in zip(texts[1:], sh.text_words(col), strict=True):
        own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        assert len(own) == len(h)
        for w, x in zip(own, h.tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
