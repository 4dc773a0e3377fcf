import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loomstone.llm import chat_tree, common, tokens

from . import helpers

PATH = tokens.public("byte_bpe_50k.json")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, part int, chain string"


@given(st.text(alphabet="<|~im_endstart>\n a"))
def test_escape_is_reversible_and_hides_control_strings(text):
    out = chat_tree.escape(text)
    assert chat_tree.unescape(out) == text and "<|" not in out
    assert chat_tree.read_head(chat_tree.head(text)) == text


def conversations(spark):
    shared = [("system", "You are <|im_end|> kind."), ("user", "hello")]
    rows = []
    for c in range(30):  # two turns shared by all, then branches
        turns = [*shared, ("assistant", f"answer {c % 4}"), ("user", None if c % 5 == 0 else f"more {c}"), ("assistant", "<~|x|> " + chat_tree.HOSTILE)][: 3 + c % 3]
        rows += [(c, t, r, x, "n", 1, "c") for t, (r, x) in enumerate(turns)]
    rows += [(40, 0, None, None, None, None, None), (40, None, "user", "first", None, None, None), (None, 0, "user", "no id", None, None, None), (41, 0, "user", "", None, None, None), (41, 0, "user", "", None, None, None), (42, 0, "us\ner", helpers.prose(1, 9000), None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def want(df):
    by = defaultdict(list)
    for r in df.collect():
        by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), "".join(f"{chat_tree.head(r)}{chat_tree.escape(x)}{chat_tree.TAIL}" for *_, r, x in ts))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_tree_and_read_back(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df, s = conversations(spark), common.Scratch(spark)
        nodes, members = chat_tree.tree(df, PATH, s)
        nodes = s.table(nodes, "tree")
        expected = want(df)
        got = {r["conv_id"]: r for r in chat_tree.read_back(nodes, members, PATH).collect()}
        assert set(got) == set(expected)
        for c, (n, turns, chars, loss, text) in expected.items():
            r = got[c]
            assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (n, turns, chars, loss, len(text))
        # The stream: every node once, gapless, and each conversation is its leaf's spans and the leaf itself.
        rows = sorted((r.asDict() for r in nodes.collect()), key=lambda r: r["start"])
        enc, stream, at = tokens.encoder(PATH), [], 0
        for r in rows:
            assert r["start"] == at
            stream += np.frombuffer(r["ids"], enc.dtype).tolist()
            at += r["n_tokens"]
            assert len(stream) == at and r["position"] == sum(x["end"] - x["start"] for x in r["spans"])
        leaf = {}
        for m in members.collect():
            if m["i"] >= leaf.get(m["conv_id"], (-1,))[0]:
                leaf[m["conv_id"]] = (m["i"], bytes(m["node"]))
        by_node = {bytes(r["node"]): r for r in rows}
        for c, (_, node) in leaf.items():
            r = by_node[node]
            ids = [t for x in [*r["spans"], {"start": r["start"], "end": r["start"] + r["n_tokens"]}] for t in stream[x["start"] : x["end"]]]
            assert enc.tok.decode(ids, skip_special_tokens=False) == expected[c][4]
        assert sum(len(np.frombuffer(r["ids"], enc.dtype)) for r in rows) < sum(r["n_tokens"] for r in got.values())
        assert len(by_node) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("wrong", ["spans", "position", "start", "ids"])
def test_a_wrong_interval_position_or_token_shows(spark, wrong):
    df, s = conversations(spark).where("conv_id in (1, 2, 3)"), common.Scratch(spark)
    nodes, leaves = chat_tree.tree(df, PATH, s)
    nodes = s.table(nodes, "tree")
    good = sorted(map(tuple, chat_tree.read_back(nodes, leaves, PATH).collect()))
    bad = {
        "spans": "transform(spans, x -> named_struct('start', x.start, 'end', x.end - 1))",
        "position": "position + 1",
        "start": "if(depth = 0, start, start + 1)",
        "ids": "if(depth = 0, concat(substring(ids, 1, length(ids) - 6), substring(ids, 1, 6)), ids)",
    }[wrong]
    try:
        got = sorted(map(tuple, chat_tree.read_back(nodes.withColumn(wrong, F.expr(bad)), leaves, PATH).collect()))
    except Exception as e:
        assert "conversation" in str(e) or "utf-8" in str(e) or "substring" in str(e)
    else:
        assert got != good


def test_query(spark, sf):
    got = {r["conv_id"]: r for r in chat_tree.op3_chat_tree(spark, sf).collect()}
    expected = want(common.read(spark, sf, "conversations"))
    assert set(got) == {-1, *expected} and got[-1]["loss_chars"] == len(chat_tree.HOSTILE)
    assert all(got[c]["turns_sha256"] == x[1] and got[c]["loss_sha256"] == x[3] for c, x in expected.items())


def test_empty_table(spark):
    s = common.Scratch(spark)
    nodes, members = chat_tree.tree(spark.createDataFrame([], SCHEMA), PATH, s)
    assert chat_tree.read_back(s.table(nodes, "tree"), members, PATH).count() == 0
