import hashlib
import random

import public_tokenizers

from tablewright.llm import chat_format as m

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "<|end|>", "<\\|end|>", "\\", "\\\\<|", "a<", "<", "|role|>", "<|endoftext|>", "<<|text|>\\|", " lead", "\n", "é🎉", "x" * 3000, "</s>[INST] ok [/INST]"]


def plain(turns):
    roles = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in roles if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(roles), sha("".join(f"{r}\n{t}\n" for r, t in roles)), len(loss), sha(loss)


def test_escape_round_trip():
    rnd = random.Random(0)
    for text in [t or "" for t in ODD] + ["".join(rnd.choice("<|\\e>") for _ in range(12)) for _ in range(2000)]:
        assert m.unescape(m.escape(text)) == text and "<|" not in m.escape(text)


def test_tokens_under_the_loss_decode_to_the_texts():
    turns = [(rnd, t or "") for t in ODD for rnd in ("user", "assistant", "<|end|>")]
    row = m.Formatter(PATH).segment(1, 0, turns)
    tokenizer = m.Formatter(PATH).tokenizer
    learnt = [m.unescape(tokenizer.decode(row["ids"][r["first"] : r["end"]], skip_special_tokens=False)) for r in row["loss_tokens"]]
    assert learnt == [t for r, t in turns if r == "assistant" and t]
    assert tokenizer.decode(row["ids"], skip_special_tokens=False) == row["formatted"]


def test_digests(spark):
    rnd, rows, want = random.Random(2), [], {}
    for conv in [None, 0, 1, 2, 3, 50]:
        turns = [(rnd.choice(["user", "assistant", "system", None, "<|"]), rnd.choice(ODD)) for _ in range(rnd.randint(1, 12))]
        rows += [(conv, i, r, t, "x") for i, (r, t) in enumerate(turns)]
        want[conv] = plain(turns)
    rows += [(60, 1, "user", "b", "x"), (60, None, "user", "c", "x"), (60, 1, "user", "a", "x"), (60, 1, "user", "a", "x")]
    want[60] = plain([("user", "c"), ("user", "a"), ("user", "a"), ("user", "b")])
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    parts = {}
    for size in (m.SEGMENT, 50):
        out = m.format_chats(df, PATH, size)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in m.digests(out).collect()}
        assert got == want
        parts[size] = {}
        for r in sorted(out.collect(), key=lambda r: (r.conv_id or -1, r.segment)):
            text, ids = parts[size].get(r.conv_id, ("", []))
            parts[size][r.conv_id] = text + r.formatted, ids + r.ids
    assert parts[50] == parts[m.SEGMENT]
    assert m.digests(m.format_chats(df.limit(0), PATH)).count() == 0
