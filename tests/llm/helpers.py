"""Small tables with the cases every operator must take: nulls, empty and long texts, repeats, clashing extra columns."""

EXTRA = ("id", "grp", "text", "tokens", "bound", "slot", "copy_key", "cut", "share", "record_id")


def table(spark, rows, schema, clash=True):
    """The rows with extra columns named like the operators' internal ones."""
    df = spark.createDataFrame(rows, schema)
    for name in EXTRA if clash else ():
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def tuples(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


TRICKY = [(1, "普通的一句话。"), (2, None), (3, ""), (4, " \n "), (5, "长" * 120_000), (6, "普通的一句话。"), (6, "普通的一句话。"), (None, "没有编号。"), (7, "a.b" * 9), (8, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
