"""Scans and registry checks read every row, whatever its id."""

from lodestone import catalog


def test_private_ids_of_every_document_and_turn(spark, tmp_path):
    texts = ["see person:4", "a model:1", "x", None, "", "Consent:\nyes", "superson:1", "(DEL:9)"]
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *["clean"] * 42, "clean as well", "upload:7"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, "to_person:1"), (3, 2, "to-person:1"), (4, 1, None)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in catalog.queries()["private_id_scan_all"](spark, str(tmp_path)).collect()}
    assert got == {(None, None, i) for i in (0, 5, 7, 51)} | {(3, 2, None)}


def test_registry_checks_read_all_orders(spark, tmp_path):
    orders = [(1, 1, "2-HIGH"), (2, 2, "1-URGENT"), (4, 3, "2-HIGH"), (5, 3, "2-HIGH"), (11, 6, "2-HIGH"), (25, 5, "2-HIGH")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i,) for i in range(1, 8)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    forks = catalog.queries()["supersedes_forks_all"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in forks] == [(0, "1,2,4,5")]
    got = {tuple(r) for r in catalog.queries()["authority_crosscheck_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "missing"), (2, 1, "excluded"), (3, 2, "duplicate"), (6, 1, "matched"), (5, 1, "missing"), (4, 0, "unlisted"), (7, 0, "unlisted")}
