"""Windows of conversations: budget, system turn, history and loss masks."""

import hashlib
import random
import re

from loomcat.llm import chat_format as C


def read(spark, rows, **options):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, windows string, turns int, i int")
    return C.windows(table, **options)


def turns_of(text):
    """The template's turns of a window."""
    return re.findall(C.TURN, text)


def marked(role, text):
    a, b = C.MARKS.get(role, (f"[ROLE]{role}[/ROLE]", "[/TURN]"))
    return a + text + b


def padded(rows):
    return [(*r, "w", 1, 2) for r in rows]


def test_windows_keep_the_budget(spark):
    rng = random.Random(3)
    rows = [(4, i, ("user", "assistant")[i % 2], f"turn{i} " * 200) for i in range(9)]
    for c in range(5, 45):
        rows += [(c, 0, "system", "rule " * rng.choice([0, 3, 40]))] * (c % 2)
        rows += [(c, 1 + i, rng.choice(["user", "assistant", "tool"]), "word " * rng.choice([0, 1, 10, 30, 49, 60])) for i in range(rng.randint(0, 30))]
    for budget in (64, 512):
        for r in read(spark, padded(rows), budget=budget).collect():
            own = [x for x in rows if x[0] == r.conv_id]
            own = [(role, text) for *_, role, text in sorted(own, key=lambda x: (x[1], x[2], x[3]))]
            size = [len(t.split()) + 2 for _, t in own]
            system = 1 if own[0][0] == "system" else 0
            done = 0
            for w in r.windows:
                marks = turns_of(w.text)
                new = len(marks) - w.repeated
                lead = system if done else 0
                assert marks[lead:] == [marked(*x) for x in own[done - (w.repeated - lead) : done + new]]
                assert marks[:lead] == [marked(*own[0])] * lead
                assert new >= 1 and w.repeated - lead <= C.HISTORY
                held = lead * size[0] + sum(size[done - (w.repeated - lead) : done + new])
                assert w.tokens == held
                assert held <= budget or (w.repeated == lead and new == 1)
                if done + new < len(own):  # another turn doesn't fit
                    assert held + size[done + new] > budget
                if done and w.repeated - lead < min(C.HISTORY, done - system):  # nor does more history beside the first new turn
                    assert lead * size[0] + sum(size[done - (w.repeated - lead) - 1 : done + 1]) > budget
                done += new
            assert done == len(own)


def test_added_conversation_and_odd_rows(spark, tmp_path):
    text = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text), (None, 1, "assistant", None), (None, 1, "assistant", None), (3, None, "assistant", "a\nb"), (3, 5, "[/ROLE]", "[&/TURN]")]
    got = {r.conv_id: r for r in C.read_back(read(spark, padded(rows))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[-7].turns_sha256 == digest([("user", text), ("assistant", text)])
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert (got[None].n_turns, got[None].loss_chars) == (2, 0)
    assert got[3].turns_sha256 == digest([("assistant", "a\nb"), ("[/ROLE]", "[&/TURN]")])
    table = spark.createDataFrame([(1, 0, "assistant", "x", "y")], "conv_id long, turn int, role string, text string, windows string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    own = {r.conv_id: r for r in C.op5_chat_windows(spark, str(tmp_path)).collect()}
    assert set(own) == {1, -7} and own[-7].turns_sha256 == got[-7].turns_sha256
    assert read(spark, []).count() == 0
