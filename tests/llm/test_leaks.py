"""Leaks that the pipeline's decontamination finds beside those of the op3 contract."""

from corpusloom.llm import decontam

SUM = "Compute 12 + 7 * 3 - 45 / 9 + 18 - 4 * 2."
TITLE = "Who Wrote The Lord Of The Rings And The Hobbit"
STORY = "Tom buys 3 apples at the market. Anna gives him 4 more pears from the garden. How many fruits does Tom carry home?"


def kept(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in decontam.decontaminate(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect())


def test_items_of_numbers_and_names_are_found(spark):
    texts = ["before " + SUM + " after", "see: " + TITLE + " here", "Compute 12 + 7 and no more than that, says the text", None, ""]
    assert kept(spark, texts, [SUM, TITLE, None, ""]) == [2, 3, 4]


def test_case_does_not_hide_an_item(spark):
    assert kept(spark, ["x " + STORY.lower(), "x " + STORY.upper() + " y", "nothing of the kind is here"], [STORY]) == [2]


def test_exact_copies_of_items_with_few_literal_words_are_found(spark):
    items = ["12 + 34 = 46 , 7 * 8 = 56 , 90 - 5 = 85", "Paris London Berlin Madrid Rome Vienna Lisbon Oslo"]
    rows = [(k, "before it " + item + " and after", "x") for k, item in enumerate(items)]
    rows += [(2, "rows 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "x"), (3, "here Anna Berta Clara Doris Emma Frida Gerda Hanna Irma", "x"), (4, items[1].upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = decontam.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.kind, r.coverage) for r in got) == [(0, 0, "verbatim", 1.0), (1, 1, "verbatim", 1.0), (4, 1, "verbatim", 1.0)]


def test_the_query_finds_an_item_in_any_case(spark):
    docs = spark.createDataFrame([(0, "x " + STORY.upper() + " y"), (1, STORY.lower()), (2, STORY.replace("3", "8").replace("Tom", "Max")), (3, STORY.title())], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(7, STORY)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.kind) for r in got) == [(0, "verbatim"), (1, "verbatim"), (2, "reparameterised"), (3, "verbatim")]


def test_long_runs_of_numbers_and_marks_of_the_text_itself(spark):
    item = "the sum of 1.5 kg and 2.5 kg is carried by nine men over the bridge"
    texts = ["1." * 100_000 + " " + item, item.replace("sum", "sum").replace("men", "men"), "A1 " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1]
