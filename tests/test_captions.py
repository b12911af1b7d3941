"""Captions: each rule by literal texts."""

import time

import pytest

from docketry.functions import captions, titles

READER = captions.Reader(titles.NOISE, titles.BODY_PHRASES, titles.ENDINGS)


@pytest.mark.parametrize("text, title", [
    ("A.M. NO. 03-1234 - RE: COMPLAINT OF X RESOLUTION", "A.M. NO. 03-1234 - COMPLAINT OF X"),
    ("A.M. NO. 11-7 (Formerly OCA)\nthe facts\nJUAN CRUZ V. PEDRO SANTOS", "A.M. NO. 11-7 - JUAN CRUZ V. PEDRO SANTOS"),
    ("EN BANC\nRE: LEAVE DIVISION JANUARY", "RE: LEAVE DIVISION"),
    ("JUAN CRUZ, COMPLAINANT, VS. JUDGE LIM, RESPONDENT.", "JUAN CRUZ, COMPLAINANT, VS. JUDGE LIM, RESPONDENT."),
    ("EN BANC\n[ G.R. No. 1 ]\nMARIA REYES, PETITIONER, VS. COURT OF APPEALS, RESPONDENT. DECISION of", "MARIA REYES, PETITIONER, VS. COURT OF APPEALS, RESPONDENT."),
    ("XXX264870,* PETITIONERS, VS. YYY, RESPONDENTS.", "XXX264870,* PETITIONERS, VS. YYY, RESPONDENTS."),
    ("ROE SONS,[1] PLAINTIFFS, V. DOE, DEFENDANTS", "ROE SONS,[1] PLAINTIFFS, V. DOE, DEFENDANTS"),
    ("FIRST DIVISION\nMARIA REYES, PETITIONER,\n\nVS.\nCOURT OF APPEALS\nAND PEDRO CRUZ, RESPONDENT.\nRESOLUTION\nMORE", "MARIA REYES, PETITIONER, VS. COURT OF APPEALS AND PEDRO CRUZ, RESPONDENT."),
    ("ANA CRUZ, PETITIONER,\nVS.\nD E C I S I O N\nX, RESPONDENT", "ANA CRUZ, PETITIONER"),
    ("ANA CRUZ, PETITIONER,\nVS.\n[G.R. No. 12]\nBEN, RESPONDENT", "ANA CRUZ, PETITIONER"),
    ("PEOPLE OF THE PHILIPPINES VERSUS\nJUAN DELA CRUZ", "PEOPLE OF THE PHILIPPINES VERSUS JUAN DELA CRUZ"),
    ("Acme Corp. vs. Delta Co. Inc.", "Acme Corp. vs. Delta Co. Inc."),
    ("x\n" * 16 + "IN RE: PETITION FOR ADOPTION OF ANA", "PETITION FOR ADOPTION OF ANA"),
    ("This petition stems from\nSOME UNUSUAL HEADING LINE\nshort", "SOME UNUSUAL HEADING LINE"),
    ("THE LONGEST LINE OF ALL THESE LINES BY FAR\nA PETITIONER IN IT", "A PETITIONER IN IT"),
    ("short", None), ("", None), (None, None),
])
def test_titles_of_texts(text, title):
    assert READER.derive(text) == title


@pytest.mark.parametrize("line, title", [
    ("JUAN, COMPLAINANT, VS. PEDRO, RESPONDENT.", "JUAN, COMPLAINANT, VS. PEDRO, RESPONDENT"),
    ("RE: A SANTOS VS. B CRUZ RESOLUTION", "A SANTOS, COMPLAINANT, VS. B CRUZ, RESPONDENT"),
    ("RE: VERIFIED COMPLAINT OF ENGR. X AGAINST JUSTICE Y", "ENGR. X, COMPLAINANT, VS. JUSTICE Y, RESPONDENT"),
    ("Re: Complaint filed by Ana against Ben", "Ana, COMPLAINANT, VS. Ben, RESPONDENT"),
    ("RE: LETTER-COMPLAINT AGAINST X FILED BY Y", "X, COMPLAINANT, VS. Y, RESPONDENT"),
    ("RE: ANONYMOUS LETTER DATED MAY 1, COMPLAINING OF MISDEEDS AGAINST CLERK Z", "CLERK Z"),
    ("RE: SUBPOENA DUCES TECUM DATED JANUARY 11, 2010 OF ACTING DIRECTOR A", "ACTING DIRECTOR A"),
    ("RE: HABITUAL TARDINESS OF B AGAINST C", "HABITUAL TARDINESS OF B"),
    ("RE: X, COMPLAINANT", "X"),
    ("IN RE: ANONYMOUS LETTER COMPLAINING AGAINST JUDGE Q, RTC", "JUDGE Q, RTC"),
    ("IN RE: PETITION FOR ADOPTION OF ANA", "PETITION FOR ADOPTION OF ANA"),
    ("RE: nothing that divides", None), ("no caption here", None),
])
def test_titles_of_administrative_cases(line, title):
    assert READER.sides(line) == title


def test_long_captions_are_left_alone():
    long = "A, PETITIONER, VS. " + "B" * 4000 + ", RESPONDENT"
    assert READER.derive(long + "\nCDE, PETITIONER, VS. FGH, RESPONDENT") == "CDE, PETITIONER, VS. FGH, RESPONDENT"


def test_long_lines_are_judged_in_one_pass():
    begun = time.process_time()
    assert not captions.two_sides("word " * 40_000)
    assert captions.two_sides("word " * 40_000 + "vs. b")
    assert time.process_time() - begun < 2
    assert [captions.two_sides(x) for x in ("a v. b", "a  VERSUS  b", "vs. b", "a vs.", "a vs.b", "a versus  ")] == [True, True, False, False, False, True]


def test_running_text_is_not_tried_by_patterns(monkeypatch):
    """Lines that hold no word of a caption are passed over; letters that only a pattern without regard to case takes for others still count."""
    tried = []
    for name in ("with_notes", "two_sides", "ends_caption", "joins_parties"):
        own = getattr(captions, name)
        monkeypatch.setattr(captions, name, lambda line, own=own: tried.append(line) or own(line))
    line = "the record shows that he was heard and that the sum was paid in full to her "
    READER.derive("\n".join([line] * 40))
    assert not tried
    assert READER.derive("ANA CRUZ, PETITıONER, VERſUS BEN REYES, REſPONDENT.\n" + line)
    assert tried
