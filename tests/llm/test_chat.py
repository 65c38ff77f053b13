from lexmill.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, n string"


def brute(rows):
    convs = {}
    key = lambda x: (x is not None, x)
    for i, (c, t, r, x, _) in enumerate(rows):
        c = (c, i if c is None else 0)
        convs.setdefault(c, []).append((key(t), key(r), key(x)))
    parts = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    keep = {}
    for c, p in parts.items():
        if not any(len(q) > len(p) and q[: len(p)] == p for q in parts.values()):
            keep.setdefault(p, []).append(c)
    out = []
    for p, cs in keep.items():
        text = "".join(f"<|im_start|>{r[1] if r[0] else 'unknown'}\n{x[1] if x[0] else ''}<|im_end|>\n" for r, x in p)
        out.append((min((c for c, _ in cs), key=lambda c: (c is None, c or 0)), len(p), len(cs), text))
    return sorted(map(str, out))


def test_keeps_maximal_conversations(spark):
    rows = []
    for c in range(40):  # snapshots of ten conversations, in all lengths
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else f"{c % 10} {t}", "x") for t in range(1 + c // 10 * 2)]
    rows += [(100, 1, None, None, "x"), (101, 1, None, "", "x"), (102, 1, None, None, "x"), (102, 2, "user", "é" * 9000, "x"), (None, 0, "user", "null id", "x"), (None, 3, "user", "null id", "x"), (None, 0, "user", "u", "x"), (104, 9, "user", "u", "x"), (None, 0, "user", "hello", "x"), (None, None, None, None, "x"), (103, None, "user", "u", "x"), (103, 1, "user", "u", "x"), (103, 1, "user", "u", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_null_and_empty_text_differ_and_empty_table(spark):
    rows = [(1, 0, "user", None, ""), (2, 0, "user", "", "")]
    assert chat.format_chats(spark.createDataFrame(rows, SCHEMA)).count() == 2
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
