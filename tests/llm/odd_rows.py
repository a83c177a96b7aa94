"""Rows that every operator must take: nulls, empty, repeated, long and strange texts."""

ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "Same text here, twice it stands."),
    (7, "Same text here, twice it stands."), (None, "a row without an id in it"), (None, None),
    (9, "twice"), (9, "twice"), (10, "été ñandú 日本語 🙂 <|endoftext|> <s> ▁x  double  space "), (11, "x" * 50_000),
    (12, "word " * 20_000), (13, "\x00 \x1c odd   marks ▁"),
]
