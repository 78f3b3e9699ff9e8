"""Small inputs with the awkward cases, and plain re-computations."""

from __future__ import annotations

import random

#: columns whose names operators use themselves
EXTRA = ("tkey", "part", "s", "w", "h", "size", "range", "label", "digest", "ids", "spans", "fp", "_row", "_text",
         "score", "predicted", "bytes", "line_dedup")


def frame(spark, rows, extra: bool = True):
    """documents with rows (doc_id, text[, source]); null n_chars, and extra
    columns of clashing names."""
    from pyspark.sql import functions as F

    rows = [(*r, "src") if len(r) == 2 else r for r in rows]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    d = d.withColumns({"lang": F.lit("en"), "n_chars": F.lit(None).cast("bigint")})
    return d.withColumns({c: F.lit(f"extra {c}") for c in EXTRA}) if extra else d


def awkward(seed: int = 3) -> list[tuple]:
    """Nulls, empty and blank texts, one very long text, copies, ties."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "A,", "b."]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    rows: list[tuple] = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words)
        if i % 4 == 0:
            text = text + "\n" + passage + "\n" + text[:30]
        if i % 5 == 0:
            text = "x" + passage + " " + text
        rows.append((i, text))
    rows += [(100, rows[0][1]), (101, rows[4][1]), (102, rows[4][1]),  # copies
             (103, None), (104, ""), (105, " \t\n "), (106, None), (107, "one"),
             (108, "again " * 300), (109, "\n".join(r.choice(vocabulary) for _ in range(3000))),
             (110, "a b c d e f g\n\n\na b c d e f g\n\n\nend"),
             (111, rows[7][1] + " " + rows[8][1])]
    rows += [(200, passage)] * 3            # a row repeated whole
    rows += [(201, passage + " x"), (201, "other text entirely, of the same document number")]
    rows += [(None, passage), (None, "no number " * 12), (-5, passage + " y"), (2 ** 62, passage)]
    return rows
