"""The allow list suppresses the part it matches, not the key beside it."""

from tessera.llm import secrets

KEY, UUID = "Q9Zr7LmT2vXc8KpW4sJd", "550e8400-e29b-41d4-a716-446655440000"


def test_allowed_part_does_not_hide_a_key(spark):
    rows = {
        1: "see samples/" + KEY + " here", 2: "é example_key=" + KEY, 3: KEY + "-Dummy", 4: f"{KEY}/example/{KEY[::-1]}",
        5: "example" + KEY, 6: UUID, 7: "samples/" + UUID, 8: "lorem-" + KEY[:10], 9: "example-" + "a1/" * 20_000 + KEY,
    }
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = {r.doc_id: r.n_entropy for r in secrets.find_secrets(df).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0, 9: 1}
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert masked[1] == "see samples[SECRET] here" and masked[2] == "é example[SECRET]" and masked[3] == "[SECRET]Dummy"
    assert all(masked[i] == rows[i] for i in (5, 6, 7, 8)) and not any(KEY in masked[i] for i in (1, 2, 3, 4, 9))
