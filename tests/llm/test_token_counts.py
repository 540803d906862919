import numpy as np
import public_tokenizers
import pytest

from settlespark.llm.encoding import _tokenizer
from settlespark.llm.token_counts import allocate, section_starts, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "web", "first line\n\n\nthird  line\n", 0), (2, None, None, 0), (None, "a", "", 0),
        (3, "b\nc", "\n\n\n\n", 0), (3, "b", "😀é\n漢字 " * 4000, 0), (4, "", "no border", 0)]


def by_character(fields, rule):
    """Every token allocated by looking at each of its characters."""
    text = "\n".join(fields)
    section_of, section, field_of = [], -1, []
    for number, field in enumerate(fields):
        section += 1
        field_of.append(number)
        body = field + ("\n" if number < len(fields) - 1 else "")
        for i, c in enumerate(body):
            section_of.append(section)
            if c == "\n" and i < len(field) - 1:
                section += 1
                field_of.append(number)
    sections = [0] * len(field_of)
    crossing = 0
    for a, b in _tokenizer(PATH).encode(text, add_special_tokens=False).offsets:
        touched = section_of[a:max(b, a + 1)]
        crossing += len(set(touched)) > 1
        sections[{"start": touched[0], "end": touched[-1],
                  "most": max(sorted(set(touched)), key=touched.count)}[rule]] += 1
    per_field = [sum(s for s, f in zip(sections, field_of) if f == k) for k in range(len(fields))]
    return sum(sections), crossing, per_field, sections


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_counts_equal_those_by_character(spark, rule):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, text string, id int")
    got = token_counts(df, PATH, ("source", "text"), rule=rule).collect()
    want = [(i, *by_character([a or "", b or ""], rule)) for i, a, b, _ in ROWS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert all(sum(r.field_tokens) == sum(r.section_tokens) == r.n_tokens for r in got)


def test_crossing_token_of_three_sections():
    starts, offsets = np.array([0, 2, 5]), np.array([[1, 6], [6, 7]])
    assert [allocate(offsets, starts, r)[0].tolist() for r in ("start", "end", "most")] == [[0, 2], [2, 2], [1, 2]]


def test_border_at_the_end_opens_no_section():
    assert section_starts(["a\n", "b"], "\n", "\n")[1].tolist() == [0, 3]


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, ["text"]).collect() == []
