"""The prefix trie against grouping every prefix in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
from strandweave.llm import prefixtrie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, path string, n long, kind int"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain(rows, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v, key=lambda t: t[:4])] for c, v in own.items()}
    if rebuild:
        h = lambda c: zlib.crc32(str(c).encode()) % 4
        turns = {c: turns.get(c - int(math.fmod(c, 20)), [])[: h(c)] + t[h(c) :] for c, t in turns.items()}
    members = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        kids = children[node]
        below[node] = (sum(below[k][0] for k in kids) or 1, (len(members[node]) - 1) * words + sum(below[k][1] for k in kids))
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(turns[c]) == len(n)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *below[n], ends(n)) for n, m in members.items())


def got(turns, most):
    return sorted(tuple(r) for r in prefixtrie.trie(turns, most).collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(90):
        # A third start alike, some are equal, some very long, and some branch late.
        path = [rng.choice("ab") if c % 3 else "hot start of a third" for _ in range(rng.choice([1, 2, 3, 5]))]
        if c % 10 == 0:
            path = ["long"] * 20 + [str(c % 20)]
        rows += [(c, t, rng.choice(["user", "user", "system"]) if c % 7 == 0 else "user", text) for t, text in enumerate(path)]
    rows += [(c, t, "user", "the very same") for c in range(100, 140) for t in range(6)]
    rows += [(200, None, None, None), (200, None, "user", "x  y\tz"), (200, 3, "user", "b"), (200, 3, "user", "a"), (200, 3, "user", "a"), (201, 0, None, "")]
    rows += [(None, 0, "user", "no id"), (-7, 0, "user", "é日本\xa0語 w"), (21, 9, "user", "w " * 3000)]
    return rows


def test_nodes_equal_plain_prefixes_when_tries_are_dealt_again(spark):
    rows = conversations()
    convs = prefixtrie.ordered(table(spark, rows)).cache()
    assert got(convs, 5) == plain(rows, False)
    assert got(convs, 10_000) == plain(rows, False)


def test_rebuilt_conversations(spark):
    rows = conversations()
    assert got(prefixtrie.rebuilt(table(spark, rows)), 40) == plain(rows, True)


def test_turnless_and_no_conversations(spark):
    alone = [(c, 0, "user", "x") for c in (23, 24, 25, 26)]  # the conversation their head is taken from is absent
    assert got(prefixtrie.rebuilt(table(spark, alone)), 5) == plain(alone, True)
    assert got(prefixtrie.rebuilt(table(spark, [])), 5) == [] and got(prefixtrie.ordered(table(spark, [(None, 1, "a", "b")])), 5) == []


def test_runs_of_equal_conversations_are_cut(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(50)]
    monkeypatch.setattr(prefixtrie, "RUN_IDS", 3)
    assert got(prefixtrie.ordered(table(spark, rows)), 5) == plain(rows, False)
