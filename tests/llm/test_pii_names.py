"""Names of several words, capitals, initials and particles; numbers that a word tells; what must stay."""

from __future__ import annotations

import re

from tessera.llm import pii

KEY = b"a key of the tests"
LEAKS = {
    1: ("Mr. John Ronald Tolkien wrote it.", ["John", "Ronald", "Tolkien"]),
    2: ("MR JOHN SMITH signed.", ["JOHN", "SMITH"]),
    3: ("We met John F. Kennedy there.", ["John", "Kennedy"]),
    4: ("Then Mary-Jane Watson left.", ["Mary", "Jane", "Watson"]),
    5: ("Frau Dr. Anna von der Berg came.", ["Anna", "Berg"]),
    6: ("Ring +49 30 1234567 today.", ["1234567", "30 1234"]),
    7: ("Please call 555-1234 now.", ["555-1234"]),
    8: ("Her SSN: 123456789 is known.", ["123456789"]),
    9: ("Passport No. X1234567 was lost.", ["X1234567"]),
    10: ("Dr. J. R. Hartley met Sr. Luis de la Vega Ortiz.", ["Hartley", "Luis", "Vega", "Ortiz"]),
    11: ("DR. ANNA BERG and Herr Hugo Stein.", ["ANNA", "BERG", "Hugo", "Stein"]),
    12: ("John Ronald Tolkien slept.", ["Ronald", "Tolkien"]),  # known with a title from the first
}
STAY = {50: "Between 555-1234 items and 123456789 others.", 51: "The Old Town Hall of New York", 52: "don Quixote, miss America, de la mer.", 53: "Version 1.2.3-4567 of 2020-2021."}


def test_no_part_of_a_name_stays(spark):
    rows = [(i, t) for i, (t, _) in LEAKS.items()] + list(STAY.items())
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    for i, (text, parts) in LEAKS.items():
        assert not [p for p in parts if p in got[i]], (text, got[i])
    assert {i: got[i] for i in STAY} == STAY
    assert re.fullmatch(r"Mr\. [A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+ wrote it\.", got[1])
    assert re.fullmatch(r"MR [A-Z]+ [A-Z]+ signed\.", got[2])
    assert re.fullmatch(r"We met [A-Z][a-z]+ [A-Z]\. [A-Z][a-z]+ there\.", got[3])
    assert re.search(r" von der [A-Z][a-z]+ came", got[5]) and re.search(r" de la [A-Z]", got[10])
    assert re.fullmatch(r"Ring \+49 \d\d \d{7} today\.", got[6]) and re.fullmatch(r"Please call \d{3}-\d{4} now\.", got[7])
    assert re.fullmatch(r"Her SSN: \d{9} is known\.", got[8]) and re.fullmatch(r"Passport No\. [A-Z]\d{7} was lost\.", got[9])
    # one person, one surrogate, with a title and without
    assert re.search(r"Mr\. (.*) wrote", got[1])[1] == re.search(r"(.*) slept", got[12])[1]
