"""Awkward documents: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp long, n int, piece string, length string, score string, component_id string, part string, rest string, word string"

TEXTS = [
    None,
    "",
    " ",
    "\n\t",
    "a",
    "a b",
    "the same text here",
    "the same text here",
    "the same text herE",
    "  two  spaces and\ttabs \x1c odd  ",
    "it's they're <|endoftext|> I'LL 12 345 €uro naïve ﬁ ▁ mark\u0000nul",
    "mail a.b+c@x-y.example.org, a@b@c.d and x@y..z or q@r.s. 10.20.30.40 300.1.1.1 1.2.3.4.5.6.7.8",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (389) 555-5010 or +44.20.7946.0958x +12",
    "see https://u:p@example.com/a?b=c. www.site.net IBAN DE89 3704 0044 0532 0130 00 account: 12345678",
    "x" * 70,
    "x" * 70 + "y",
    "x" * 300,
    ("word " * 20000).strip(),
    ("word " * 20000).strip(),
    "Ünïcödé 日本語 текст 😀" * 30,
]


def rows():
    out = [(i, t, "en", "s", len(t or ""), 7, 1, "p", "l", "s", "c", "q", "r", "w") for i, t in enumerate(TEXTS)]
    out += [out[6], out[11]]  # repeated rows
    out.append((None, "no id", None, None, None, None, None, None, None, None, None, None, None, None))
    out.append((2**53 + 1, "large id", None, None, None, None, None, None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
