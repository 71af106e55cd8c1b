import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import license_scan, mixing, quality_model, quality_rules, shared, token_count, token_output, vocabulary
from plumbline.llm import words as W
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_row(frame, *columns):
    """Rows as a multiset, doc_id first."""
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


def test_word_hashes_tell_words_apart():
    texts = [t for _, t, *_ in cases.rows()]
    got = W.Words(*W.buffers(pa.array(texts)))
    flat = [w for t in texts for w in cases.words(t)]
    assert got.count.tolist() == [len(cases.words(t)) for t in texts]
    h = got.hashes()
    assert len(set(flat)) == len(set(h.tolist())) and len({(w, x) for w, x in zip(flat, h.tolist(), strict=True)}) == len(set(flat))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té中", max_size=30), max_size=8))
def test_words_of_any_texts(texts):
    got = W.Words(*W.buffers(pa.array(texts, pa.string())))
    assert got.count.tolist() == [len(cases.words(t)) for t in texts]


def counts(text):
    text = text or ""
    w = cases.words(text)
    lines = [x for x in text.split("\n") if cases.words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def verdict(text):
    n, chars, symbols, dup, repeated, lines = counts(text)
    w, own = cases.words(text), [x for x in (text or "").split("\n") if cases.words(x)]
    bullets = sum(cases.words(x)[0][0] in "-*•" for x in own)
    dots = sum(cases.words(x)[-1].endswith(("...", "…")) for x in own)
    letters = sum(re.search(r"[A-Za-z]|[^\x00-\x7F]", x) is not None for x in w)
    if bullets > 0.9 * lines or dots > 0.3 * lines or 2 * letters < n:
        return False
    up, low = len(re.findall("[A-Z]", text or "")), len(re.findall("[a-z]", text or ""))
    return not (n < 50 or 100 * repeated > 50 * n or symbols > 0.3 * n or chars < 2 * n or chars > 20 * n or up > 0.6 * (up + low) or dup > 0.3 * lines)


def listed(seed, mark="", end=""):
    return "\n".join(mark + " ".join(f"w{i} {cases.words(cases.prose(seed + i, 9))[0]}" for i in range(k, k + 9)) + end for k in range(0, 90, 9))


LISTED = [
    listed(900, "- "), listed(910, "\t• "), listed(920, end="...  "), listed(930, end=" …"), " ".join(f"{i}:{i}" for i in range(90)),
    "...", "..", ".\n..", "-", "a..\n.", "é -", "* " * 80,
]


def test_quality_rules(spark, docs, none):
    got = quality_rules.cascade(docs, report=True)
    want = Counter((i, *counts(t)[:5], verdict(t)) for i, t, *_ in cases.rows())
    assert by_row(got, "doc_id", *quality_rules.REPORT, "kept") == want
    assert [c for c in docs.columns if c != "kept"] == got.columns[: len(docs.columns) - 1]
    assert quality_rules.cascade(none).count() == 0 and quality_rules.plan(none)
    odd = quality_rules.cascade(spark.createDataFrame(list(enumerate(LISTED)), "doc_id long, text string"), quality_rules.RULES[::-1], report=True)
    assert by_row(odd, "doc_id", *quality_rules.REPORT, "kept") == Counter((i, *counts(t)[:5], verdict(t)) for i, t in enumerate(LISTED))
    assert {r["rejected_by"] for r in odd.where("doc_id < 5").collect()} == {"bullet_lines", "ellipsis_lines", "wordless"}


def test_order_of_rules_changes_nothing(docs):
    back = quality_rules.cascade(docs, tuple(reversed(quality_rules.RULES)))
    assert by_row(back, "doc_id", "kept") == by_row(quality_rules.cascade(docs, quality_rules.RULES), "doc_id", "kept")
    assert by_row(quality_rules.cascade(docs), "doc_id", "kept", "rejected_by") == by_row(quality_rules.cascade(docs), "doc_id", "kept", "rejected_by")


def test_order_of_rules_does_not_hang_on_where_rows_lie(spark):
    rows = [(i, ("LOUD " if i % 3 else "### ") * 60 if i % 2 else cases.prose(i, 80)) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    orders = [[r.name for r in quality_rules.plan(frame.repartition(n), sample_rows=100)] for n in (1, 3, 8)]
    assert orders[0] == orders[1] == orders[2]
    by = [by_row(quality_rules.cascade(frame.repartition(n)), "doc_id", "kept", "rejected_by") for n in (1, 8)]
    assert by[0] == by[1]


def test_rules_run_by_rejections_for_what_their_missing_counts_cost():
    def texts(rows):
        return quality_rules.Texts(*W.buffers(pa.array(rows, pa.large_string())))

    loud = ["LOUD " * 60] * 6 + [cases.prose(i, 80) for i in range(6)]
    order = quality_rules.ordered(quality_rules.RULES, texts(loud))
    assert [r.name for r, _, _ in order][0] == "upper_case" and order[0][2] == 0.5
    # what is made in any case costs nothing, so a rule over it comes first if it rejects anything
    repeats = [f"{cases.prose(40, 30)} " * 4] * 3 + loud
    free = quality_rules.ordered(quality_rules.RULES, texts(repeats), quality_rules.REPORT)
    assert free[0][0].name == "repeated_words" and free[0][1] == 0
    for rules in ([r for r, _, _ in order], list(quality_rules.RULES)):
        kept, by = quality_rules.run(rules, t := texts(loud + ["", "a b"]))
        assert kept.tolist() == [verdict(x) for x in [*loud, "", "a b"]] and (by[:6] >= 0).all()
    # a document that is rejected leaves later counts unmade
    t = texts(["LOUD " * 60] * 4)
    quality_rules.run([r for r, _, _ in order], t)
    assert "n_upper" in t._made and "n_repeat_words" not in t._made and "lines" not in t._made
    assert quality_rules.missing(("n_dup_lines",), {"bytes"}) == {"n_dup_lines", "lines", "line_spans", "words"}


def library(text):
    return vocabulary.load(vocabulary.vocabulary_path()).encode(text or "", add_special_tokens=False).ids


ODD = ["It's a <|endoftext|>x they'll", "a.b,c!!...  x", "\x1c x\x85y z", "ＡＢ ﬁ Σίσυφος ΣΑΣ", "aaaaaaaaa", "<|startoftext|><|endoftext|>", "á ́b"]


def test_token_counts(spark, docs, none):
    want = Counter((i, len((t or "").encode()), len(library(t)), len(library(t)) > 2048) for i, t, *_ in cases.rows())
    assert by_row(token_count.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_count.count_tokens(none).count() == 0
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.count_tokens(odd).collect()} == {i: len(library(t)) for i, t in enumerate(ODD)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_tokens_of_any_texts(texts):
    path = vocabulary.vocabulary_path()
    own, column = token_output.encoder(path), pa.array(texts, pa.string())
    ids = own.encode(column)
    want = [library(t) for t in texts]
    assert np.split(ids.flat, np.cumsum(ids.lengths)[:-1])[0].tolist() == want[0] if texts else True
    assert ids.flat.tolist() == [x for w in want for x in w]
    assert token_count.merger(path).count(column).tolist() == [len(w) for w in want]


def test_token_files(spark, docs, none):
    path = token_output.write_tokens(docs, shared.new_path(spark, "t"))
    rows = token_output.read_tokens(spark, path).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((i, (*library(t), 2)) for i, t, *_ in cases.rows())
    crc = by_row(token_output.with_crc(token_output.read_tokens(spark, path)), "doc_id", "ids_crc32")
    assert crc == Counter((i, zlib.crc32(np.array([*library(t), 2], "<u4").tobytes())) for i, t, *_ in cases.rows())
    assert token_output.encode_and_read(none).count() == 0
    plan = token_output.read_tokens(spark, path, ("doc_id", "n_tokens"))._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_licences(spark, docs, none):
    got = by_row(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")

    def want(i, text):
        w = re.findall(license_scan.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
        places = [(k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        return i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))

    assert got == Counter(want(i, t) for i, t, *_ in cases.rows())
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs).collect()}
    assert labels[18] == ("apache,apache-2.0", 1.0) and labels[0] == ("", 0.0) and labels[19][0].startswith("gpl,")
    assert license_scan.scan(none).count() == 0


def licences(text):
    """Labels of templates and the score, by brute force over all places."""
    index = license_scan.Index()
    w = re.findall(license_scan.WORD, "".join(c.lower() if c.isascii() else c for c in text or ""))
    rare, joined = set(), f" {' '.join(w)} "
    at, labels, score = defaultdict(list), set(), 0.0
    for v, posts in zip(index.vocabulary, index.postings, strict=True):
        rare |= {(t, p, v) for t, p in posts}
    for i, x in enumerate(w):
        at[x].append(i)
    for t, template in enumerate(index.templates):
        own = Counter(i - p for k, p, v in rare if k == t for i in at[v])
        n = max(own.values(), default=0)
        score = max(score, n / index.most[t])
        if n >= index.need[t] and all(f" {m} " in joined for m in template.mandatory):
            labels.add(template.label)
    return labels, score


def test_licence_templates_against_brute_force(spark):
    r = random.Random(4)
    texts = [t.text for t in license_scan.TEMPLATES]
    files = [f"{cases.prose(i, 20)} {t} {cases.prose(50 + i, 20)}" for i, t in enumerate(texts)] + ["\n\n".join(texts), "license of public general mit the version 3 gnu under licensed", "", None]
    for _ in range(40):
        some = " ".join(r.sample(texts, 3)).split()
        for _ in range(r.randint(0, 12)):
            k = r.randrange(len(some))
            some[k : k + r.randint(0, 2)] = r.choice(([], ["word"]))
        files.append(" ".join(some))
    got = {x["doc_id"]: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(files)), "doc_id long, text string")).collect()}
    for i, text in enumerate(files):
        labels, score = licences(text)
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == base | labels and got[i]["score"] == pytest.approx(score)
        if i < len(texts):
            # the last part of a licence counts in the whole text alone
            assert license_scan.TEMPLATES[i].label in labels or len(license_scan.TEMPLATES[i].mandatory) > 1
    assert licences(files[len(texts)])[0] == {t.label for t in license_scan.TEMPLATES}
    assert not licences(files[len(texts) + 1])[0]


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(cases.words(t))) for i, t, *_ in cases.rows())
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in rows:
        copies[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], len(cases.words(r["text"]))) for r in out.collect()) == +copies


def test_mixing_targets(spark):
    def brute(sizes):
        names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
        w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
        while open_:
            total = sum(w[s] for s in open_)
            over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
            if not over:
                return out | {s: left * w[s] / total for s in open_}
            for s in over:
                out[s] = 2 * sizes[s]
            left, open_ = left - sum(out[s] for s in over), open_ - over
        return out

    for sizes in ({"a": 100, "b": 900, None: 50, "c": 7}, {"a": 5}, {"b": 0, "a": 10, "é": 1000, "z": 3}):
        rows = mixing.targets(spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")).collect()
        assert {r["source"]: pytest.approx(r["target"]) for r in rows} == brute(sizes)


def spark_hash(*values):
    """Spark's xxhash64 of (number, bytes) and strings, unsigned; nulls leave the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h).intdigest()
    return h


def pivotal(items, seed, level):
    """The loop of one block over [doc_id, size, p]: what is settled, and the residual."""
    held, done = list(items[0]), []
    for k, x in enumerate(map(list, items[1:])):
        if 0 < held[2] < 1:
            up, down = min((1 - held[2]) * held[1], x[2] * x[1]), min(held[2] * held[1], (1 - x[2]) * x[1])
            up_full, down_full = (1 - held[2]) * held[1] <= x[2] * x[1], held[2] * held[1] <= (1 - x[2]) * x[1]
            ids = [None if i is None else (i, 8) for i in (held[0], x[0])]
            u = (spark_hash((seed, 4), (level, 4), *ids, (k, 4), (held[1], 8), (x[1], 8)) >> 11) * 2.0**-53
            if goes_up := u * (up + down) < down:
                held[2], x[2] = (1.0, min(1.0, max(0.0, x[2] - up / x[1]))) if up_full else (min(1.0, max(0.0, held[2] + up / held[1])), 0.0)
            else:
                held[2], x[2] = (0.0, min(1.0, max(0.0, x[2] + down / x[1]))) if down_full else (min(1.0, max(0.0, held[2] - down / held[1])), 1.0)
            if up_full if goes_up else down_full:
                held, x = x, held
            done.append((x[0], x[1], int(x[2])))
        else:
            done.append((held[0], held[1], int(held[2])))
            held = x
    return done, held


def test_mixing_against_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(i if i else None, " ".join(f"w{r.randrange(9)}" for _ in range(r.choice((0, 1, 3, 10, 80))))+ f" {i}", r.choice(("a", "b", "b", "b", None))) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((x["doc_id"], x["size"], x["source"], x["copies"]) for x in mixing.mix(frame.repartition(4)).collect())
    sizes = [(i, len(cases.words(t)), s, t) for i, t, s in rows]
    totals = {s: (sum(1 for x in sizes if x[2] == s), sum(x[1] for x in sizes if x[2] == s)) for s in {x[2] for x in sizes}}
    goals = {x["source"]: x["target"] for x in mixing.targets(spark.createDataFrame([(s, *v) for s, v in totals.items()], "source string, n long, source_size long")).collect()}
    want = Counter()
    for s, (n, total) in totals.items():
        whole, p = divmod(goals[s] / total, 1)
        blocks = defaultdict(list)
        for i, size, of, t in sizes:
            if of == s:
                h = spark_hash((17, 4), None if i is None else (i, 8), (size, 8), ((spark_hash(t) + 2**63) % 2**64 - 2**63, 8), (1, 4))
                blocks[((h + 2**63) % 2**64 - 2**63) % max(1, -(-n // mixing.FAN_IN))].append((i, size, p))
        if not p:
            want.update((i, size, s, int(whole)) for own in blocks.values() for i, size, _ in own)
            continue
        level, most = 0, max(1, -(-max(v[0] for v in totals.values()) // mixing.FAN_IN))
        while True:
            above = defaultdict(list)
            for b, own in blocks.items():
                done, held = pivotal(sorted(own, key=lambda x: (-x[1], x[0] is not None, x[0] or 0, x[2])), 17, level)
                want.update((i, size, s, int(whole) + c) for i, size, c in done)
                above[b // mixing.FAN_IN].append(tuple(held))
            if most == 1:
                break
            blocks, most, level = above, -(-most // mixing.FAN_IN), level + 1
        want.update((i, size, s, int(whole) + (q >= 0.5)) for own in above.values() for i, size, q in own)
    assert got == want and level > 0


def test_mixing_comes_near_its_targets(spark):
    many = spark.createDataFrame([(i, "w " * (1 + i * 7919 % 60), "big" if i % 3 else f"s{i % 5}") for i in range(3000)], "doc_id int, text string, source string")
    got = mixing.mix(many).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 31 for r in got)


def test_classifier(spark, docs, none):
    good = [(i, cases.prose(100 + i, 40 + i * 13 % 300)) for i in range(240)]
    bad = [(1000 + i, ("### %% " + cases.prose(i, 2) + " ") * (5 + i % 30)) for i in range(240)]
    both = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.classify(both, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] < 1000) for r in held) / len(held) > 0.95
    odd = quality_model.classify(docs, labels).collect()
    assert len(odd) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.classify(none, labels).count() == 0


def test_classifier_equals_the_formula():
    rng = np.random.default_rng(3)
    x0, x1 = rng.normal(0, 1, (50, 3)), rng.normal(1, 2, (80, 3))
    model = quality_model.fit_sums({k: (float(len(x)), x.sum(0), x.T @ x) for k, x in ((0, x0), (1, x1))}, 0.0, 0.0)
    p = rng.normal(0, 2, (5, 3))

    def density(x, at):
        c = np.cov(x.T, bias=True) + quality_model.RIDGE * np.eye(3)
        d = at - x.mean(0)
        return -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c)))

    z = density(x1, p) - density(x0, p) + np.log(80 / 50)
    assert model.scores(p) == pytest.approx(1 / (1 + np.exp(-z)))


def test_words_that_are_met_again_stay_remembered():
    asked = Counter()

    def learn(words):
        asked.update(words)
        return token_count.Counts(np.array([zlib.crc32(w) for w in words], np.int64))

    own = W.Remembered(learn, 8)
    for k in range(40):
        text = " ".join([*(f"often{i}" for i in range(20)), *(f"once{k}x{i}" for i in range(30))])
        words = W.Words(*W.buffers(pa.array([text])))
        numbers = own.numbers(words)
        assert own.store.n[numbers].tolist() == [zlib.crc32(w.encode()) for w in text.split()]
        assert own.index.n <= 128
    assert max(asked.values()) == 1
    # more at once than there is room for, and again after it
    for text in [" ".join(f"many{i}" for i in range(500)), "often1 many3", " ".join(f"many{i}" for i in range(3000))]:
        words = W.Words(*W.buffers(pa.array([text])))
        numbers = own.numbers(words)
        assert own.store.n[numbers].tolist() == [zlib.crc32(w.encode()) for w in text.split()]


def test_encoders_forget_and_stay_right():
    text = pa.array([cases.prose(k, 60) for k in range(300)])
    path = vocabulary.vocabulary_path()
    large, small = token_output.Encoder(path), token_output.Encoder(path, 9)
    merger = token_count.Merger(path, 9)
    for i in range(0, 300, 10):
        want, got = large.encode(text[i : i + 10], 2), small.encode(text[i : i + 10], 2)
        assert want.flat.tolist() == got.flat.tolist() and want.lengths.tolist() == got.lengths.tolist()
        assert (merger.count(text[i : i + 10]) + 1).tolist() == want.lengths.tolist()
