import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import divergence, sentence_pieces, spelling, vocabulary
from plumbline.llm import runs as R
from plumbline.llm import words as W
from tests.llm import cases

PATH = vocabulary.vocabulary_path(sentence_pieces.FILE)
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.COLUMNS).repartition(3).cache()


# runs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aZ1 é×ÿĀ中\n_", max_size=30), max_size=8))
def test_runs_of_any_texts(texts):
    for kind, pattern in ((R.terms, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (R.latin, r"[A-Za-zÀ-ÿ]+")):
        found = [x for t in texts for x in re.findall(pattern, t)]
        got = [own.data[b:e].tobytes().decode() for _, own in R.blocks(pa.array(texts, pa.string()), kind) for b, e in zip(own.begin, own.end, strict=True)]
        assert got == [x.translate(UPPER) for x in found]


def test_counter_lets_go_and_loses_nothing():
    texts = [cases.prose(i, 300) for i in range(30)]
    held, got = R.Counter(1, 6), Counter()

    def take(parts):
        for _, found, sums in parts:
            got.update(dict(zip(found.to_pylist(), sums[0].tolist(), strict=True)) if len(set(found.to_pylist())) == len(found) else pytest.fail("a run twice"))

    for t in texts:
        for _, own in R.blocks(pa.array([t]), R.terms):
            which = np.arange(len(own.begin))
            take(held.add(own, which, own.hashes(), np.zeros(len(which), np.int8), [np.ones(len(which))]))
    take(held.rest())
    assert got == Counter(x.translate(UPPER) for t in texts for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))


# op11


def divergences(rows, least, k):
    groups, at, df = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = [x.translate(UPPER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(w)
        at[lang or ""].update(w)
        df[lang or ""].update(set(w))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def share(counts, kept=kept, v=v):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * v) for t in kept}

        p, q = share(groups[lang, source]), share(at[lang])
        others = [(sum(abs(p[t] - x) for t, x in share(groups[g]).items()), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [(p[t] - q[t], t) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", others), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= k}
    return out


def test_divergence(spark, docs):
    r = random.Random(3)
    made = [(" ".join(r.choice(("ka", "Ri", "tö", "中文", "a1b")) + str(r.choice("xyzé")) * r.randint(1, 3) for _ in range(r.randint(0, 50))), r.choice(("de", "", None)), r.choice(("s1", "s2", "s2", "é", None))) for _ in range(150)]
    made.append(("!", "lonely", "here"))
    odd = [(t, lang, source) for _, t, lang, source, *_ in cases.rows()]
    for rows, least, k in ((made, 5, 7), (odd, 2, 50), (odd, 30, 50)):
        frame = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(rows)], "doc_id int, text string, lang string, source string, value int").repartition(3)
        got = [tuple(x) for x in divergence.audit(frame, least, k).collect()]
        assert len(got) == len(set(got)) and set(got) == divergences(rows, least, k)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_radix_selection_refines_ties_by_bytes(spark):
    r = random.Random(5)
    items = sorted({"".join(r.choice("aé中z") for _ in range(r.randint(1, 20))) for _ in range(400)})
    rows = [(g, x, r.choice((7, 7, 7, 2**30 - 1, 1 << 20)) if g < 2 else 3) for g in range(4) for x in items[: (400, 400, 300, 12)[g]]]
    frame = spark.createDataFrame(rows, "g int, item string, value long").repartition(5)
    for ordered in (1, 20, 4096):
        got = divergence.top(frame, ["g"], "value", "item", 40, ordered=ordered).collect()
        want = {(g, x, v, i) for k in range(4) for i, (g, x, v) in enumerate(sorted((y for y in rows if y[0] == k), key=lambda y: (-y[2], y[1].encode()))[:40], 1)}
        assert {(x["g"], x["item"], x["value"], x["rank"]) for x in got} == want and len(got) == len(want)


# op12


def library(proto):
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def held_against(own, theirs, texts):
    e = own.encode(pa.array(texts, pa.string()))
    upto = np.concatenate([[0], np.cumsum(e.n)])
    decoded = own.decode(e.ids, e.n)
    for k, t in enumerate(texts):
        want = theirs.encode(t or "", return_type="proto").pieces
        cut = slice(upto[k], upto[k + 1])
        assert e.ids[cut].tolist() == [p.id for p in want]
        assert [*zip(e.begin[cut].tolist(), e.end[cut].tolist(), strict=True)] == [(p.begin, p.end) for p in want]
        assert decoded[k].decode() == theirs.decode([p.id for p in want])


ODD = ["", None, " ", "  a", "a  b ", "\n", "\ta", "▁▁x ▁", "<s>hi</s><unk><0x0A>", "é\U0001f600ßñ", "日本語 テキスト", "a\x00b", "x" * 700, "    " * 50 + "q", "ﬁ ①", "İ", "là\r\n\r\n", "１２３", " " * 300, "ab" * 90]


def test_pieces_of_the_file():
    own, theirs = sentence_pieces.Processor(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    held_against(own, theirs, ODD + [t for _, t, *_ in cases.rows()])
    assert own.encode(pa.array([], pa.string())).ids.tolist() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text(" ▁ab\nthe1é", max_size=60), max_size=6))
def test_pieces_of_any_texts(texts):
    held_against(sentence_pieces.processor(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), texts)


def number(x):
    return bytes([x]) if x < 128 else bytes([x & 127 | 128]) + number(x >> 7)


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("extra", [0, 1])
@pytest.mark.parametrize("mapped", [True, False])
def test_compiled_character_maps(mapped, prefix, extra):
    """The file with other rules of normalisation, held against the library with the same."""
    charsmap = b""
    if mapped:
        proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
        charsmap = dict(sentence_pieces.fields(dict(sentence_pieces.fields(proto))[3]))[2]
    spec = b"\x0a\x04test\x12" + number(len(charsmap)) + charsmap + b"\x18" + bytes([prefix]) + b"\x20" + bytes([extra])
    with open(PATH, "rb") as f:
        proto = f.read() + b"\x1a" + number(len(spec)) + spec
    own, theirs = sentence_pieces.Processor.of(sentence_pieces.Spec.parse(proto)), library(proto)
    held_against(own, theirs, ODD)
    r = random.Random(prefix + 2 * extra)
    for _ in range(15):
        held_against(own, theirs, ["".join(r.choice(" ▁ \n\tabthe é日\U0001f600<0x_A.1ﬁ́ﬃ①㍿ﾊﾟｶﾞ​　\xa0½가한") for _ in range(r.randint(0, 30))) for _ in range(20)])
    for _ in range(100):
        ids = [r.choice([28705, 259, 278, 5, 100, 1, 2, 0, 263, 10]) for _ in range(r.randint(0, 8))]
        assert own.decode(np.array(ids, np.int32), np.array([len(ids)]))[0].decode() == theirs.decode(ids)


def test_decoding_of_any_ids():
    own, theirs, r = sentence_pieces.Processor(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), random.Random(2)
    rows = [[r.randrange(32000) if r.random() < 0.5 else r.choice([0, 1, 2, 28705, 259, *range(3, 259)]) for _ in range(r.randint(0, 12))] for _ in range(300)]
    got = own.decode(np.array([i for x in rows for i in x], np.int32), np.array([len(x) for x in rows]))
    assert [g.decode() for g in got] == [theirs.decode(x) for x in rows]


def test_bytes_that_are_no_utf8():
    own = sentence_pieces.Processor(PATH)
    broken = pa.Array.from_buffers(pa.string(), 2, pa.array(["abcd", "ef"]).buffers()[:2] + [pa.py_buffer(b"a\xffb\xe2ef")])
    e = own.encode(broken)
    assert b"".join(own.decode(e.ids, e.n)).decode() == "a�b�ef"


def test_piece_digests(spark, docs):
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def row(i, t):
        ids = theirs.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return i, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids)), len((t or "").encode())

    got = Counter(map(tuple, sentence_pieces.digests(docs).collect()))
    assert got == Counter(row(i, t) for i, t, *_ in cases.rows())
    assert sentence_pieces.digests(docs.limit(0)).count() == 0
    encoded = sentence_pieces.encode(docs).where("doc_id < 13")
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(encoded).collect()}
    assert back == {i: t or "" for i, t, *_ in cases.rows() if i is not None and i < 13}
    assert all(len(r["ids"]) == len(r["begins"]) == len(r["ends"]) for r in encoded.collect())


# op13


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near_ = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: f if (f := min(near_[w], key=lambda x: (-n[x], x), default=None)) and n[f] >= 2 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near_[w]), n.get(form[w])) for w in n}


def test_spelling_variants(spark, docs):
    r = random.Random(8)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(4, 8))) for _ in range(60)]
    texts = [" ".join(w if r.random() < 0.7 else w[: (k := r.randrange(len(w)))] + r.choice(("", "a", "É", "ÿ")) + w[k + r.randint(0, 1) :] for w in r.choices(base, [1 / (k + 1) for k in range(60)], k=40)) for _ in range(120)]
    texts.append("chainw " * 4 + "chainwo " * 10 + "chainwor " * 25 + "chainword " * 60)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in spelling.variants(frame).collect()]
    want = variants(enumerate(texts))
    assert set(got) == want and len(got) == len(want) and sum(f is not None for _, f, *_ in got) > 20
    assert max(sum(1 for _ in chain(w, {x[0]: x[1] for x in want})) for w in {x[0] for x in want}) > 3
    odd = [tuple(x) for x in spelling.variants(docs.drop("h")).collect()]
    assert set(odd) == variants((i, t) for i, t, *_ in cases.rows()) and len(odd) == len(set(odd))
    assert spelling.variants(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "y" * 50_000 + " " + "y" * (50_000 + i % 2)) for i in range(6)], "doc_id long, text string")
    assert {x["n_near"] for x in spelling.variants(long).collect()} <= {1, 2}


def chain(word, form):
    while word:
        yield word
        word = form[word]


@pytest.mark.parametrize(("head", "cell", "together"), [(4, 10**6, 50_000), (4, 20, 64), (2, 5, 10), (3, 1, 1)])
def test_cells_of_any_size_find_the_same_pairs(spark, head, cell, together):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(5, 9))) for _ in range(500)})
    n = {w: i for i, w in enumerate(words)}
    got = [tuple(x) for x in spelling.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long"), head, cell, together).collect()]
    assert sorted(got) == sorted((x, y, n[y]) for x in words for y in words if near(x, y))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("abé", max_size=7)), max_size=40, unique=True))
def test_trie_self_join(rows):
    rows = sorted(rows, key=lambda x: (x[0], x[1]))
    words = [w for _, w in rows]
    cell = np.unique([c for c, _ in rows], return_inverse=True)[1] if rows else np.zeros(0, np.int64)
    points, lengths = spelling.code_points(pa.array(words, pa.string()))
    a, b = spelling.near(points, lengths, cell, np.zeros(len(rows), bool))
    assert sorted(tuple(sorted((i, j))) for i, j in zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and near(words[i], words[j])]


def test_crc_of_spans():
    raw = [cases.prose(i, 3).encode() * (1 + 9 * (i % 3 == 0)) for i in range(50)] + [b""]
    ends = np.cumsum([len(x) for x in raw])
    begin = np.concatenate([[0], ends[:-1]])
    before = np.array([zlib.crc32(str(i).encode()) for i in range(len(raw))], np.uint32)
    got = spelling.crc32(np.frombuffer(b"".join(raw), np.uint8), begin, ends, before)
    assert got.tolist() == [zlib.crc32(x, int(p)) for x, p in zip(raw, before, strict=True)]
    assert len(W.span_hashes(np.zeros(0, np.uint8), begin[:0], ends[:0])) == 0
