DOC = "doc_id long, text string"


def texts(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


ODD = [(1, None), (2, ""), (3, "a"), (4, "one two three four five six"), (4, "one two three four five six"), (None, "no id here at all"), (7, " \n\t "), (8, "word " * 30_000), (9, "x" * 100_000), (10, "é 日本 😀 tail.")]
