"""Documents with every odd case, and plain Python versions of what the operators do."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int, node string, score string, h string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(("ka", "ri", "to", "ne", "mo", "lu", "sé", "ða")) + r.choice("aeiou") * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(n)]
    return " ".join(w + ("\n" if r.random() < 0.08 else "") for w in words)


def rows() -> list[tuple]:
    base = prose(1, 160)
    near = base.split(" ")
    near[80] = "changed"
    passage = prose(2, 70)
    item = "the quick brown fox jumps over the lazy dog while seven green turtles watch the river in silence"
    texts = [
        base, base, " ".join(near), None, "", " \n\t ", "one", "two words", prose(3, 400), f"{prose(4, 60)} {passage} {prose(5, 60)}", f"{prose(6, 90)} {passage}",
        f"{prose(7, 30)} {item.upper()} {prose(8, 40)}", f"{prose(9, 60)} {item.replace('seven', 'sevan')}.", "### $$$ " * 60, "same same same " * 40, "LOUD WORDS! " * 60,
        "x" * 300_000, prose(10, 20_000), "All of it is licensed under the Apache License, Version 2.0.\n" + prose(11, 70), "The MIT\nLicense. MIT License; GNU General Public License version 3", "a\nb\nc\nd\ne\nf\n" * 8,
        "tail\n", "é" * 10 + " İ ß Σ \U0001f600",
    ]
    out = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i % 3}", None if t is None else len(t), True, 1, "n", "s", "h") for i, t in enumerate(texts)]
    out.append(out[8])  # a repeated row
    out.append((None, base, "en", "src1", 1, None, None, None, None, None))
    out.append((None, prose(12, 90), None, None, None, None, None, None, None, None))
    return out


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven green turtles watch the river in silence"), (2, "a passage that stands nowhere in these documents at all, not even nearly so"), (3, None), (4, "?!"), (None, prose(3, 400)[200:420]), (1, "repeated id that is nowhere")]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0
