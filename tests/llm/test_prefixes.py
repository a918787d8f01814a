"""The conversation trie against plain Python and its SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from pageloom.llm import prefixes, queries
from pageloom.llm.oracles import ORACLES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * words
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if whole[c] == p).encode()).hexdigest()) for p, m in list(members.items()))


def found(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(*COLUMNS).collect())


def test_op13_against_plain_python_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(queries.op13_conversation_prefixes(spark, "/root/testdata/sf0.01"))
    assert got == brute(rows) and max(r[1] for r in got) > 3
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    rel = con.sql(ORACLES["op13_conversation_prefixes"])
    assert rel.columns == COLUMNS
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in rel.fetchall()) == got


@pytest.mark.parametrize("turns_per_block", [1 << 17, 40, 3])
def test_shared_prefixes_over_many_blocks(spark, turns_per_block):
    """A third of the conversations are equal, many start alike; blocks are cut within and between them."""
    rng = random.Random(turns_per_block)
    rows = []
    for c in range(240):
        turns = [("user", "hello there"), ("assistant", "what can I do")] + [("user", rng.choice("ab")) for _ in range(rng.randrange(5))]
        turns = [("user", "same"), ("bot", "all the same words"), ("user", "end")] if c % 3 == 0 else turns if c % 5 else [(rng.choice("xyz"), str(c))]
        rows += [(c - 40, k, r, t) for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = prefixes.prefix_trie(df, turns_per_block)
    assert found(got) == brute(rows)
    ranks = {(r.conv_id, r.depth): (r.first_rank, r.first_rank + r.n_convs, r.parent_conv_id) for r in got.collect()}
    assert ranks[min(ranks)][:2] == (0, 240)
    for (_, depth), (a, b, parent) in ranks.items():
        assert depth == 0 or ranks[parent, depth - 1][0] <= a and b <= ranks[parent, depth - 1][1]


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a  b c\x0bd"), (1, 0, "user", ""), (2, 5, "", ""), (2, 7, "u", "x " * 5000), (None, 1, "u", "x"), (20, 1, "u", "x"),
            (-3, 1, "u", "x"), (-3, 2, "u", "x"), (-3, 2, "u", "x"), (-25, 1, "1:", "x"), (25, 1, "1", ":x"), (9 * 10**18, 1, "u", "x"), (3, None, "u", None), (4, 2, "user", "日本 語")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], SCHEMA + ", block int, keys string").repartition(3)
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()))
    for turns_per_block in (1 << 17, 1):
        assert found(prefixes.prefix_trie(df, turns_per_block)) == brute(order)
    assert prefixes.prefix_trie(df.limit(0)).count() == 0
    # Conversation 1 has no turns of its own after its first h, and no base: it ends at the root.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    c = next(c for c in h if h[c])
    assert found(prefixes.prefix_trie(spark.createDataFrame([(c, 0, "u", "x")], SCHEMA))) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
