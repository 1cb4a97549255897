"""The requests of ``chat_answers``: every user turn is asked, and every document."""

import __spark_entry__ as entry
import pytest

from lectern.catalog.documents import every_turn_requests, turn_requests

SAID = "conv_id long, turn long, role string, text string"


def stored(spark, folder, doc_ids, said) -> str:
    docs = [(d, f"Alpha beta document {d}. It tells of gamma rays and of rivers.") for d in doc_ids]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(said, SAID).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def talk(conv, n):
    """``n`` user turns, each with an answer that is not asked."""
    return [row for t in range(n) for row in ((conv, 2 * t, "user", f"question {conv} {t}"), (conv, 2 * t + 1, "assistant", "an answer"))]


@pytest.mark.parametrize(
    "doc_ids, said, n",
    [
        (range(4), talk(0, 7) + talk(1, 1), 7 + 2),  # a conversation of more turns than documents
        (range(2), [r for c in range(5) for r in talk(c, 2)], 10),  # fewer documents than conversations
        ([-7, 3, 10**12], talk(5, 2) + talk(10**15, 9) + talk(None, 3), 14),  # ids far apart, turns of no conversation
    ],
)
def test_all_turns_and_documents_are_asked(spark, tmp_path, doc_ids, said, n):
    got = every_turn_requests(spark, stored(spark, tmp_path, doc_ids, said)).collect()
    asked = [r["message"] for r in got]
    assert {text for _, _, role, text in said if role == "user"} == set(asked)
    assert {r["doc_id"] for r in got} == {str(d) for d in doc_ids}
    assert len({r["request_id"] for r in got}) == len(got) == n


def test_without_documents_or_turns_there_is_nothing_to_ask(spark, tmp_path):
    assert every_turn_requests(spark, stored(spark, tmp_path / "a", [], talk(0, 2))).count() == 0
    assert every_turn_requests(spark, stored(spark, tmp_path / "b", [1, 2], [])).count() == 0


def test_short_conversations_are_dealt_as_before(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = lambda made: sorted(map(tuple, made(spark, sf_dir).collect()))
    assert rows(every_turn_requests) == rows(turn_requests)


def test_chat_answers_every_turn(spark, tmp_path):
    sf_dir = stored(spark, tmp_path, range(2), talk(0, 5))
    assert entry.queries()["chat_answers"](spark, sf_dir).count() == 5
