"""Small document tables with the awkward cases."""

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, _words string, ids string, h string, `__row` string, `__z` string, row string, c0 string, n_bytes string"


def documents(spark, texts, ddl=DDL):
    """Numbered from 0, with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, None, "s", None, 1.5, "x", "y", "z", "r", "q", "w", "c", "n") for i, t in enumerate(texts)], ddl)


AWKWARD = [
    None, "", " ", "\n\n", "one", "one two", "a a a a a a a a a a a a a a", "Tie tie TIE", "Tie tie TIE", "x" * 40_000, "w " * 30_000,
    "café İstanbul ΟΔΟΣ ß ﬁ  nbsp em \x1c fs \x85 nel", "it's we'll I'M they've 3rd 1234 ½ ² ٣", "<|endoftext|> mid <|startoftext|><|endoftext|>x",
    "emoji 👩‍👩‍👧 🇫🇷 中文 テスト", "tab\tsep\x0bvt\x0cff\r\ncr", "'s 'S ''s l'eau", "\x00 nul", "...,,,!!", "a.b,c", "Σ ΑΣ. ΑΣ, ΑΣΑ",
]
