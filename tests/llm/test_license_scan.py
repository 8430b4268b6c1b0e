from candlewick.llm import license_scan as ls


def test_places_labels_and_edges(spark):
    texts = [
        (1, None),
        (2, ""),
        (3, "cc"),
        (4, "CC by, cc BY cc by"),
        (5, "General public license. All rights reserved"),
        (6, "Licensed under the Apache License, Version 2.0."),
        (7, "Licensed under the terms of the Apache License Version 2.0"),
        (8, "general license public; rights reserved all"),
        (9, "x Released under the MIT License"),
        (9, "x Released under the MIT License"),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, label string")
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in ls.scan(df).collect())
    assert got == [
        (1, 0, 0, None, None, "", ""),
        (2, 0, 0, None, None, "", ""),
        (3, 1, 0, None, None, "", ""),
        (4, 6, 3, 0, 4, "cc-by", "cc-by"),
        (5, 6, 2, 0, 3, "gpl,reserved", "gpl,reserved"),
        (6, 8, 0, None, None, "", "apache-2.0"),
        (7, 11, 0, None, None, "", "apache-2.0"),
        (8, 6, 0, None, None, "", ""),
        (9, 6, 0, None, None, "", "mit"),
        (9, 6, 0, None, None, "", "mit"),
    ]
    assert ls.scan(df.limit(0)).count() == 0


def test_repeated_words_are_no_license(spark):
    texts = ["under the under the under the", "under the mit under the mit", "x under the mit license", "released under our the mit license", "by 4 0 by 4 0 by 4 0 under cc under cc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in ls.scan(df).orderBy("doc_id").collect()] == ["", "", "mit", "mit", ""]


def test_long_texts_are_scanned_whole(spark):
    text = "lorem ipsum " * 50_000 + "cc by " + "dolor " * 50_000 + "released under the MIT license"
    (row,) = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (150_007, 1, 100_000, "cc-by,mit")
