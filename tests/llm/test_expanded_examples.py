"""Chat examples with their whole context, read back by the query."""

import hashlib

from lodestone.llm import chat_format, queries


def test_the_chat_query_reads_expanded_examples(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b#"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e"), (2, 0, "user", "f")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    full = chat_format.expand(chat_format.format_conversations(turns), rest=True)
    got = {(r.conv_id, r.example): (r.text, r.text[r.loss_start : r.loss_start + r.loss_length] if r.loss_length else None, r.last) for r in full.collect()}
    one = "### user: a</turn>\n### assistant: b\\h</turn>\n"
    two = one + "### user: c</turn>\n### assistant: d</turn>\n"
    assert got == {(1, 0): (one, "b\\h", False), (1, 1): (two, "d", False), (1, 2): (two + "### user: e</turn>\n", None, True), (2, 0): ("### user: f</turn>\n", None, True)}
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    seen, expand = [], chat_format.expand
    monkeypatch.setattr(chat_format, "expand", lambda *a, **k: seen.append(1) or expand(*a, **k))
    out = {r.conv_id: r for r in queries.op3_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert seen and set(out) == {1, 2, -7}
    assert (out[1].n_turns, out[1].loss_chars, out[1].loss_sha256, out[1].formatted_chars) == (5, 3, sha("b#d"), len(two) + 19)
    assert out[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1))
