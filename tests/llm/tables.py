"""Small awkward tables."""

LONG = "word and sentence number " * 20_000

#: Names that the operators add or use inside.
CLASH = ["tokens", "block", "shard", "removed", "gone", "ht", "hit_id", "score", "keep", "group_id", "root", "chosen_blocks", "own_source", "key", "rep", "rest", "id"]

_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (4, "   \n\t "), (5, "... !!! ---"), (6, LONG), (7, LONG), (8, "a"),
    (9, "The quick brown fox jumps over the lazy dog near the river bank today"), (9, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today"), (None, None), (10, "x" * 100_000), (11, "naïve café 東京 \U0001f600 ​ end"), (12, "line one\nline two\r\nline one\n"),
]


def docs(spark, rows=None, clash=True):
    """documents with extra columns of clashing names, null sources and n_chars."""
    rows = _TEXTS if rows is None else rows
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASH if clash)
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 4 == 0 else f"s{n % 4}", None if t is None else len(t), *(["own"] * len(CLASH) if clash else [])) for n, (i, t) in enumerate(rows)], ddl)


def labels(spark, rows=()):
    return spark.createDataFrame([(i, q, t, "own") for i, q, t in rows], "doc_id long, quality int, toxic int, text string")


def as_set(df):
    return {tuple(r) for r in df.collect()}
