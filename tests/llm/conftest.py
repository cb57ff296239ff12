"""Helpers of the training-data tests."""

from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def planted_texts() -> list[tuple[int | None, str | None]]:
    """Small documents with copies, shared passages, odd white space, nulls and long runs."""
    rng = random.Random(7)
    words = [w + x for w in "ab cd ef gh ij kl mn op".split() for x in ("", "é", "z", "ß9")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(45), prose(24)
    texts: list[str | None] = [prose(rng.randint(1, 90)) for _ in range(40)]
    texts += [f"{prose(9)}\n{passage}\t {prose(rng.randint(0, 40))}" for _ in range(8)]
    texts += [f"{line}\n{line}\n{prose(5)}\n{line}" for _ in range(4)]
    texts += [texts[3], texts[3], f" {texts[41]} ", passage[:170], passage[5:], "", None, None, "   \n", "!" * 300, "!" * 180, "x " * 90, "x " * 60]
    texts += [prose(400), prose(19), "\0\x1c" + passage, passage + " " + passage]
    ids = list(range(5, 5 + 3 * len(texts), 3))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))
