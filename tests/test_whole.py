"""Catalogue queries that take every word and row of their input."""

from paralex.plans.catalogue import MARKUP, QUERIES


def test_pad_and_shift_takes_all_words(spark, tmp_path):
    texts = {1: "a " * 45 + "bbb", 2: "cc dd", 3: " ".join(["word"] * 130), 11: "x", 12: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["pad_and_shift_whole"](spark, str(tmp_path)).collect()}
    ids = {1: [1] * 45 + [3] + [0] * 84, 2: [2, 2] + [0] * 128, 3: [4] * 130, 11: [1]}
    assert {k: r["source_padded"] for k, r in got.items()} == ids
    assert all(r["target_in"] == ids[k][:-1] and r["target_out"] == ids[k][1:] for k, r in got.items())


def test_domain_pool_takes_all_domains(spark, tmp_path):
    rows = [(3, "a\nb", "en"), (6, "c\nd", "de"), (4, "e\nf", "en"), (5, "g\nh", "de"), (7, "i\nj", "fr"), (8, "k\nl", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["domain_pool_semi_whole"](spark, str(tmp_path)).collect()
    assert sorted(r["ord"] >> 24 for r in got) == [4, 5, 8]


def test_weighted_loss_takes_all_events(spark, tmp_path):
    rows = [(1, 1, "click", 1.0), (1, 2, "view", 4.0), (2, 3, "view", 2.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["token_weighted_loss_whole"](spark, str(tmp_path)).first()["loss"] == 2.5


def test_markup_rule_runs_in_the_whole_validator(spark, tmp_path):
    """Pages, their addresses and all snippets are judged, with the duplicates among them."""
    rows = [(0, "http://a", "<p>x</p>"), (1, "http://a", "<p>y</p>"), (2, "http://b", "<p><br></p>"), (3, None, "<p>z</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["reasons"] for r in QUERIES["markup_reasons"](spark, str(tmp_path)).collect()}
    assert len(got) == 4 * (2 + len(MARKUP))
    assert got[-2] == "" and got[-1] == "duplicate_pair,source_duplicate,target_duplicate"
    assert got[0] == got[1] == "target_duplicate,conflicting_translation"
    assert got[2] == "target_duplicate,conflicting_translation,malformed_markup" and got[3] == "empty,missing_value"
    assert [got[(1 << 32) + k] == "" for k in range(len(MARKUP))] == [ok for _, ok in MARKUP]
    assert [got[(2 << 32) + k].startswith("duplicate_pair") for k in range(len(MARKUP))] == [ok for _, ok in MARKUP]
