from plumbline.llm import chat


def frame(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_best_branches_and_reading_back(spark):
    rows = [
        (1, 1, None, "user", "hi <|im_end|> \\| é", 0.0), (1, 2, 1, "assistant", "a\\", 1.0),
        (1, 3, 1, "assistant", "b <|im_start|>", 3.0), (1, 4, 3, "user", "", None), (1, 5, 4, "assistant", "c\n<", 1.0),
        (1, 6, 2, "user", "more", 9.0), (2, 1, 99, "system", "alone", 0.0),
        (3, 1, 2, "user", "on a cycle", 0.0), (3, 2, 1, "user", "on a cycle", 0.0),
    ]
    messages = frame(spark, rows)
    paths = chat.best_paths(messages, "score", branches=2)
    got = {(r.tree, r["rank"]): r for r in chat.read_back(chat.formatted(messages, paths)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert [t.text for t in got[1, 1].turns] == ["hi <|im_end|> \\| é", "a\\", "more"]
    assert [t.text for t in got[1, 2].turns] == ["hi <|im_end|> \\| é", "b <|im_start|>", "", "c\n<"]
    assert got[1, 2].loss_text == "b <|im_start|>c\n<" and got[2, 1].loss_text == ""
    assert got[1, 2].formatted.count(chat.START) == 4


def test_deep_chain_and_ties(spark):
    rows = [(7, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)]
    rows += [(7, 100, 3, "user", "short", 0.0)]
    messages = frame(spark, rows)
    got = chat.read_back(chat.formatted(messages, chat.best_paths(messages))).collect()
    assert [t.text for t in got[0].turns] == [str(i) for i in range(37)]  # equal scores: smallest leaf


def test_threads_keep_odd_rows(spark):
    rows = [(1, 2, "assistant", None, 5), (1, 1, None, "q", 5), (1, 2, "assistant", None, 5), (None, None, "user", "x" * 20000, 5)]
    messages = chat.threads(spark.createDataFrame(rows, "c long, t long, role string, text string, tree int"), "c", "t")
    got = {r.tree: r for r in chat.read_back(chat.formatted(messages, chat.best_paths(messages))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "q"), ("assistant", ""), ("assistant", "")]
    assert got[None].turns[0].text == "x" * 20000
    empty = chat.threads(spark.createDataFrame([], "c long, t long, role string, text string"), "c", "t")
    assert chat.formatted(empty, chat.best_paths(empty)).count() == 0
