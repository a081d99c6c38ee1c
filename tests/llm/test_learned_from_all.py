"""Profiles and limits come from all labelled documents."""

from barloom.llm import language


def test_every_document_counts(spark):
    docs = spark.createDataFrame([(i, "abc", "x") for i in range(4000)], "doc_id long, text string, lang string")
    learned = docs.where(language.remainder(docs.doc_id) != 2)
    batches = learned.select("lang", "text").mapInArrow(language.gram_counts, "lang string, gram string, n bigint")
    assert batches.where("gram = 'abc'").agg({"n": "sum"}).first()[0] == learned.count()
    # One rare document in thousands shows in the profile, whatever its id.
    for rare in [i.doc_id for i in learned.orderBy("doc_id").limit(3).collect()]:
        changed = docs.selectExpr("doc_id", f"IF(doc_id = {rare}, 'qqq', text) AS text", "lang")
        assert language.learn(changed).where("gram = 'qqq'").count() == 1
