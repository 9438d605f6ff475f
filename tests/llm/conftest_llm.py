#: Null, empty, white space only, one word, a repeated row, ties, and a very long text.
def odd_rows(words):
    long = words(60_000, 3)
    return [
        (1, None, None), (2, "", "a"), (3, " \t\n\x0b\f\r", "a"), (4, "one", "a"), (4, "one", "a"), (5, "o n e", "b"), (6, "one", "b"),
        (None, "nameless text of some words", "b"), (None, None, None), (7, long, "c"), (8, long + " end", "c"), (9, "éß你 \U0001f600", "c"),
    ]
