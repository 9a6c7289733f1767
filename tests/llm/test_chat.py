import hashlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from corpusgauge.llm import chat
from corpusgauge.llm.queries import public_vocabulary
from corpusgauge.session import materialise

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, uses int"


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary("byte_bpe_50k.json")


@settings(max_examples=400, deadline=None)
@given(st.text("<[\\/s>INSTY|]ax\n", max_size=24))
@example("</s>[INST] ok [/INST]")
@example("<<SYS>><</SYS>><\\|<|<\\\\|start|>")
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert mark not in hidden


def conversations():
    rows = []

    def add(conv, *turns):
        rows.extend((conv, k, role, text, "x", 1) for k, (role, text) in enumerate(turns))

    hello, reply = ("user", "Hello <|stop|> there"), ("assistant", "</s>[INST] ok [/INST] é\n")
    for k in range(30):
        add(k, hello, reply, ("user", f"question {k % 4}"), ("assistant", f"answer {k % 9}"))
    add(40, hello, reply)
    add(41, hello)
    add(42, ("system", "be"), hello, reply)
    add(43, (None, None), ("assistant", None), ("assistant", ""), ("user\n<|says|>", "\\<|"))
    add(44, *[(("user", "assistant")[k % 2], f"turn {k} " + "x" * (k % 5)) for k in range(300)])
    add(None, hello, ("assistant", "of no conversation"))
    rows.append((45, None, "user", "first", "", 0))
    rows.append((45, 3, "assistant", "b", "", 0))
    rows.append((45, 3, "assistant", "a", "", 0))
    rows.append((45, 3, "assistant", "a", "", 0))
    rows.append((-1, 5, "assistant", "word " * 30000, "", 0))
    return rows


def ordered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def expected(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    size = sum(len(chat.header(r) + chat.escape(t) + chat.STOP) for r, t in turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(turns), sha(said), len(learned), sha(learned), size)


@pytest.mark.parametrize("tasks", [1, 8])
def test_round_trip_and_tree(spark, vocabulary, tasks):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        rows = conversations()
        stream, ways = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), vocabulary)
        got = {r["conv_id"]: tuple(r[c] for c in chat.DIGESTS) for r in chat.read_back(stream, ways, vocabulary).collect()}
        want = ordered(rows)
        assert got == {k: expected(t) for k, t in want.items()}
        nodes = {bytes(r["node"]): r.asDict(recursive=True) for r in stream.collect()}
        prefixes = {tuple(t[:k]) for t in want.values() for k in range(1, len(t) + 1)}
        assert len(nodes) == len(prefixes)  # each shared start is emitted once
        at = 0
        for n in sorted(nodes.values(), key=lambda n: n["start"]):
            assert n["start"] == at and n["n"] == len(n["ids"])
            at += n["n"]
        ways_of = {}
        for r in ways.orderBy("place").collect():
            ways_of.setdefault(r["conv_id"], []).append(bytes(r["node"]))
        for way in ways_of.values():
            seen = []
            for node in way:
                n = nodes[node]
                assert n["position"] == sum(m["n"] for m in seen)
                allowed = {p for s in n["ancestors"] for p in range(s["start"], s["stop"])}
                assert allowed == {p for m in seen for p in range(m["start"], m["start"] + m["n"])}
                seen.append(n)
            # depth first: a path's nodes follow in the stream
            assert [m["start"] for m in seen] == sorted(m["start"] for m in seen)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_subtrees_are_contiguous(spark, vocabulary):
    stream, ways = chat.format_conversations(spark.createDataFrame(conversations(), SCHEMA), vocabulary)
    place = {bytes(r["node"]): (r["start"], r["start"] + r["n"]) for r in stream.collect()}
    below = {}
    for r in ways.groupBy("conv_id").agg(chat.F.array_sort(chat.F.collect_list(chat.F.struct("place", "node"))).alias("w")).collect():
        way = [bytes(x["node"]) for x in r["w"]]
        for k, node in enumerate(way):
            below.setdefault(node, set()).update(way[k:])
    for nodes in below.values():
        spans = sorted(place[n] for n in nodes)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty_table(spark, vocabulary):
    stream, ways = chat.format_conversations(spark.createDataFrame([], SCHEMA), vocabulary)
    assert stream.count() == ways.count() == chat.read_back(stream, ways, vocabulary).count() == 0


def test_loss_mask_covers_the_assistant_text_only(spark, vocabulary):
    laid = materialise(chat.lay_out(spark.createDataFrame(conversations(), SCHEMA), vocabulary))
    tokenizer = chat.load_tokenizer(vocabulary)
    for r in laid.where("conv_id = 3").collect():
        for t in r["turns"]:
            ids = [i for i, m in zip(t["ids"], chat.loss_mask(t.asDict())) if m]
            body = tokenizer.decode(t["ids"][t["header"] : t["header"] + t["body"]], skip_special_tokens=False)
            assert (tokenizer.decode(ids, skip_special_tokens=False) if ids else "") == (body if t["role"] == "assistant" else "")
