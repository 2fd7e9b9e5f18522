import hashlib

from pointloom.llm import personal_data as pii


def test_long_secrets_and_handles_are_masked(spark):
    key = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(5))  # 320 characters
    handle = "b." * 39 + "b" + " (at) " + ".".join("abcdefghijkl") + ".com"
    rows = [(-1, f'token = "{key}" end'), (-2, f"contact {handle} end")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {r.doc_id: r.text for r in pii.mask(docs).where("doc_id < 0").collect()}
    assert text == {-1: 'token = "[SECRET]" end', -2: "contact [HANDLE] end"}
