"""Entities and relations of a text by patterns: capitalised names, verbs between them, and what speakers say of themselves."""

from __future__ import annotations

import re

import pandas as pd
from quillgraph.functions.vectorised import arrow_udf

OPENERS = frozenset("A All Also An And Are As At Be Both But By Each For From He Here I In Is It Layer Now Of On Or Our She Step That The Their Then There These They This Those To Use Used Using Was We Were When Will With You Your".split())
_WORD, _ACRONYM = "[A-Z][a-z0-9]+", "[A-Z]{2,}(?:-[A-Z0-9]+)?"
NAME = re.compile(rf"\b(?:[0-9]+[A-Za-z]+|{_WORD}|{_ACRONYM})(?:[ -](?:[A-Z][A-Za-z0-9]+|{_ACRONYM}|[0-9]+))*\b")
_CAPITAL = "[A-Z][A-Za-z0-9.&]*"
SUBJECT = rf"({_CAPITAL}(?:[ -]{_CAPITAL})*)"
#: relation: verbs that stand for it between two names
STATED = {
    "works_at": "joined|now works at|is employed (?:by|at)|work(?:s|ed)? (?:for|at)",
    "lives_in": "relocated to|moved to|(?:is )?based in|resides? in|live[sd]? in",
    "led_by": "runs|heads|(?:is )?led by|leads|ceo of|is (?:the )?(?:ceo|head) of",
    "founded": "started|(?:co-)?founded",
    "acquired": "(?:has )?acquired|purchased|bought",
    "partners_with": "is partnering with|partner(?:s|ed)? with",
    "married_to": "married|(?:is )?married to",
    "born_in": "(?:was )?born in",
    "reports_to": "reporting to|reports? to",
    "manages": "is (?:the )?manager of|manages",
    "created": "invented|designed|developed|built|created",
    "authored": "authored|wrote",
    "invested_in": "back(?:s|ed)|funded|invested in",
    "member_of": "(?:is )?part of|belongs to|(?:is (?:a )?)?member of",
    "headquartered_in": "(?:is )?headquartered in",
    "owns": "owned by|owns",
    "studied_at": "attended|graduated from|studied at",
    "visited": "flew to|traveled to|went to|visited",
    "met": "met(?: with)?",
}
#: relation: verbs of talk, after I or a name
SAID = {
    "visited": "(?:have )?been to|(?:drove|flew|traveled|went) to|visited",
    "likes": "(?:am|'m) into|adores?|prefers?|enjoys?|likes?|loves?",
    "dislikes": "can(?:'t|not) stand|dislikes?|hates?",
    "has": "ha(?:s|ve) an?|purchased|owns?|adopted|bought|got",
    "does": "practices?|plays?",
    "is_a": "(?:am|'m) an?|works? as",
    "wants_to": "would love to|plan(?:ning)? to|hope to|wanna|want to",
}
_THING = r"(?:(?:a|an|another|her|his|my|new|our|some|the|their) )?([A-Za-z][A-Za-z'-]+(?:[ -][A-Za-z][A-Za-z'-]+){0,2})"
_SELF = r"\b[Ii]\b\s+(?:(?:also|finally|just|really|recently) )?"
EMPTY = frozenset("anything bit day days everyone everything fun good great her here him it kind lately lot lots me much myself nice now one ones part really some someone something sort stuff sure that them then there thing things this time times today us way ways yeah you yourself".split())
MONTHS = "january february march april may june july august september october november december".split()
STOPS = frozenset([m for m in MONTHS if m != "may"] + "sunday saturday friday thursday wednesday tuesday monday".split() + "a about after ago also and at because before but for her here his in just last month months my next now of on or our recently really since so that the their then there this to today tomorrow too week weeks when where which while who with year years yesterday".split())
_RULES = [(re.compile(rf"{SUBJECT}\s+(?:{verbs})\s+{SUBJECT}"), p) for p, verbs in STATED.items()]
_TALK = [r for p, verbs in SAID.items() for r in ((re.compile(rf"{_SELF}(?:{verbs})\s+{_THING}"), p, True), (re.compile(rf"{SUBJECT}\s+(?:{verbs})\s+{_THING}"), p, False))]
_SPEAKER = re.compile(r"^\s*([A-Z][A-Za-z][A-Za-z .'-]*?)\s*(?:\([^)]*\))?\s*:\s*(.*)$")


def slug(s: str) -> str:
    return re.sub("[^a-z0-9]+", "-", s.lower()).strip("-")


def names(unit: str) -> list[tuple[str, str, str]]:
    """(id, label, type) of the names in a piece of text, each once."""
    out: dict[str, tuple[str, str, str]] = {}
    for m in NAME.finditer(unit):
        label = m[0].strip()
        if len(label) < 2 or label in OPENERS or (len(label) < 3 and not set(" -") & set(label)):
            continue
        key = slug(label)
        if key:
            out.setdefault(key, (key, label, "ACRONYM" if re.fullmatch("[A-Z0-9-]+", label) else "CONCEPT"))
    return list(out.values())


def _trimmed(s: str) -> str:
    return re.sub(r"[.&\s]+$", "", s.strip()).strip()


def thing(s: str) -> str | None:
    """An object's leading words up to a word that begins another clause."""
    words = []
    for w in s.split():
        if w.lower() in STOPS:
            break
        words.append(w)
    t = re.sub("['-]+$", "", " ".join(words)).strip()
    low = t.lower()
    return None if len(t) < 3 or low in EMPTY or all(w in EMPTY for w in low.split()) else t


def extract(text: str | None, most_stated: int = 200, most_said: int = 300) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str, float | None]]]:
    """Entities (id, label, type) and relations (from, to, type, confidence)."""
    text = text or ""
    entities: dict[str, tuple[str, str, str]] = {}
    near: dict[tuple[str, str], tuple] = {}
    stated: dict[tuple[str, str, str], tuple] = {}
    said: dict[tuple[str, str, str], tuple] = {}
    for unit in re.split(r"[\n.;]+", text):
        found = names(unit.strip())
        for e in found:
            entities.setdefault(e[0], e)
        for i, a in enumerate(found):
            for b in found[i + 1 : i + 6]:
                x, y = sorted((a[0], b[0]))
                near[x, y] = (x, y, "relates_to", None)

    def put(into: dict, most: int, a_label: str, b_label: str, p: str, a_type: str, b_type: str, sure: float) -> None:
        a, b = slug(a_label), slug(b_label)
        if len(into) < most and a and b and a != b and (a, p, b) not in into:
            entities.setdefault(a, (a, a_label, a_type))
            entities.setdefault(b, (b, b_label, b_type))
            into[a, p, b] = (a, b, p, sure)

    for rule, p in _RULES:
        for m in rule.finditer(text):
            x, y = _trimmed(m[1]), _trimmed(m[2])
            if len(x) >= 2 and len(y) >= 2:
                put(stated, most_stated, x, y, p, "ENTITY", "ENTITY", 0.6)
    for line in re.split("\n+", text):
        m = _SPEAKER.match(line)
        speaker, body = (m[1].strip(), m[2]) if m else (None, line)
        for rule, p, own in _TALK:
            if own and not speaker:
                continue
            for m in rule.finditer(body):
                who, what = speaker if own else _trimmed(m[1]), thing(m[1 if own else 2])
                if who and len(who) >= 2 and what:
                    put(said, most_said, who, what, p, "PERSON" if own else "ENTITY", "CONCEPT", 0.5)
    return list(entities.values()), [*near.values(), *stated.values(), *(v for k, v in said.items() if k not in stated)]


KIND = "entities array<struct<id:string,label:string,type:string>>, relations array<struct<from:string,to:string,type:string,confidence:double>>"


@arrow_udf(KIND)
def extract_knowledge(texts: pd.Series) -> pd.DataFrame:
    rows = [extract(t) for t in texts]
    return pd.DataFrame(
        {
            "entities": [[dict(zip(("id", "label", "type"), e)) for e in es] for es, _ in rows],
            "relations": [[dict(zip(("from", "to", "type", "confidence"), r)) for r in rs] for _, rs in rows],
        }
    )
