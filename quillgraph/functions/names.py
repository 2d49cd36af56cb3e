"""When two names mean one entity: normal forms, blocking keys and match rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import pandas as pd
from quillgraph.functions.vectorised import arrow_udf

TITLES = frozenset("capt dr hon lt madam madame miss mr mrs ms mx prof rev sgt sir".split())
LEGAL = frozenset("ab ag as bv co company corp corporation gmbh inc incorporated limited llc llp lp ltd nv oy plc pvt sa srl".split())
SMALL = frozenset("a an and at by de el for in la le of on the to van von".split())
UNTOLD = SMALL | LEGAL | TITLES
SHORT = dict(zip("assn assoc bros dept depts govt intl mfg natl univ".split(), "association association brothers department departments government international manufacturing national university".split()))
FORMAL = {
    nick: formal
    for formal, nicks in (x.split("=") for x in (
        "andrew=andy;anthony=tony;benjamin=ben benny;charles=chuck charlie;daniel=danny dan;david=davey dave;donald=don;edward=eddie ed;"
        "elizabeth=eliza betty beth lizzie liz;frederick=freddy fred;gregory=greg;james=jimmy jim;jeffrey=jeff;jennifer=jenny jen;joseph=joey joe;"
        "joshua=josh;katherine=kathy katie kate;kenneth=ken;margaret=peggy meg maggie;matthew=matt;michael=mikey mike;nicholas=nick;"
        "patricia=patti patty;peter=pete;rebecca=becky;richard=richie dick rich rick;robert=robbie rob bobby bob;ronald=ron;stephen=steve;"
        "susan=susie sue;thomas=tommy tom;timothy=tim;william=willie will billy bill;zachary=zack zach").split(";"))
    for nick in (formal, *nicks.split())
}
BUCKETS = (
    ("person", "AUTHOR|EMPLOYEE|HUMAN|INDIVIDUAL|PEOPLE|PERSON|USER"),
    ("org", "AGENCY|BRAND|COMPANY|CORP|CUSTOMER|GROUP|INSTITUTION|ORG|TEAM|VENDOR"),
    ("place", "ADDRESS|CITY|COUNTRY|GEO|GPE|LOC|PLACE|REGION|STATE"),
    ("work", "BOOK|DOCUMENT|EVENT|MODEL|PAPER|PRODUCT|PROJECT|WORK"),
)


@functools.lru_cache(4096)
def bucket(kind: str | None) -> str:
    up = (kind or "").strip().upper()
    return next((b for b, words in BUCKETS if up and re.search(words, up)), "generic")


def compatible(a: str, b: str) -> bool:
    return "generic" in (a, b) or a == b


def normal(name: str, b: str = "generic") -> list[str]:
    """The words of a name without what its kind of entity doesn't need."""
    plain = lambda s: re.sub("[^a-z0-9]+", " ", s).split()
    low = name.lower()
    words = [SHORT.get(w, w) for w in plain(re.sub(r"['’]s\b", "", re.sub(r"\s+&\s+", " and ", low)))]
    if b == "person":
        words = [w for w in words if w not in TITLES]
    elif b == "org":
        while len(words) > 1 and words[-1] in LEGAL:
            words.pop()
    return words or plain(low)


def initials(words: list[str]) -> list[str]:
    if len(words) < 2:
        return []
    both = ("".join(w[0] for w in words), "".join(w[0] for w in words if w not in SMALL))
    return [x for x in dict.fromkeys(both) if len(x) >= 2]


def _telling(words: Iterable[str]) -> list[str]:
    return [w for w in words if len(w) >= 2 and w not in UNTOLD]


def index_keys(name: str, b: str = "generic") -> list[str]:
    """Keys that an entity is found under."""
    return _index(normal(name, b))


def _index(words: list[str]) -> list[str]:
    own = _telling(words)
    return list(dict.fromkeys([*own, *(FORMAL[w] for w in own if FORMAL.get(w, w) != w), *initials(words)]))


def lookup_keys(name: str, b: str = "generic") -> list[str]:
    """Keys that a name looks under: its longest word, formal forms of nicknames, initials."""
    return _lookup(normal(name, b))


def _lookup(words: list[str]) -> list[str]:
    longest = max((w for w in words if w not in SMALL), key=len, default=None)
    return list(dict.fromkeys([*([longest] if longest else []), *(FORMAL[w] for w in _telling(words) if FORMAL.get(w, w) != w), *initials(words)]))


def osa(a: str, b: str, most: int = 2) -> int:
    """Edit distance with swaps of neighbours, or most + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def within_one(a: str, b: str) -> bool:
    """osa(a, b, 1) <= 1, from the first place where they differ."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def match(a: str, a_kind: str | None, b: str, b_kind: str | None) -> tuple[bool, float, str]:
    """(whether, how sure, why)."""
    ba, bb = bucket(a_kind), bucket(b_kind)
    none = (False, 0.0, "none")
    if not compatible(ba, bb):
        return none
    shared = bb if ba == "generic" else ba
    wa, wb = normal(a, shared), normal(b, shared)
    sa, sb = " ".join(wa), " ".join(wb)
    if not sa or not sb:
        return none
    if sa == sb:
        return True, 1.0, "equal"
    if (len(wa) == 1 and wa[0] in initials(wb)) or (len(wb) == 1 and wb[0] in initials(wa)):
        return True, 0.95, "acronym"
    if min(len(sa), len(sb)) >= 6 and within_one(sa, sb):
        return True, 0.9, "typo"
    if shared == "person":
        fa, fb = ([FORMAL.get(w, w) for w in x] for x in (wa, wb))
        if fa == fb:
            return True, 0.9, "equal"
        few, many = sorted((fa, fb), key=len)
        known = len(few) >= 2 or (len(few[0]) >= 4 and few[0] not in SMALL | LEGAL)
        if len(few) < len(many) and set(few) <= set(many) and known:
            return True, 0.85, "containment"
    return none


def name_class(name: str, kind: str | None) -> dict:
    """What the rules see of a name: names with equal class ids match the same names.

    looks and index are the blocking keys; the normal forms are among them, so that equal forms always meet. A pair
    that is equal or an acronym shares a key of near in one and of far in the other; texts holds the forms that are
    long enough for a typo. few holds the words whose presence in another person's words would be containment, many
    the words that may hold them.
    """
    b = bucket(kind)
    forms = {s: normal(name, s) for s in ((b,) if b != "generic" else ("generic", "person", "org"))}
    if not forms[b]:
        return {"node": None, "looks": [], "index": [], "near": [], "far": [], "texts": [], "few": [], "many": []}
    whole = list(dict.fromkeys("=" + " ".join(w) for w in forms.values()))
    looks, index = _lookup(forms[b]) + whole, _index(forms[b]) + whole
    near, far, few, many = set(whole), set(whole), [], []
    for s, words in forms.items():
        short, long = words if len(words) == 1 else [], initials(words)
        near.update([*("<" + x for x in short), *(">" + x for x in long)])
        far.update([*("<" + x for x in long), *(">" + x for x in short)])
        if s == "person":
            formal = [FORMAL.get(w, w) for w in words]
            near.add("+" + " ".join(formal))
            far.add("+" + " ".join(formal))
            many = sorted(set(formal))
            if len(formal) >= 2 or (len(formal[0]) >= 4 and formal[0] not in SMALL | LEGAL):
                few = many
    texts = [w[1:] for w in whole if len(w) > 6]
    node = "|".join([b, *(" ".join(w) for w in forms.values())])
    return {"node": node, "looks": looks, "index": index, "near": sorted(near), "far": sorted(far), "texts": texts, "few": few, "many": many}


@arrow_udf("node string, looks array<string>, index array<string>, near array<string>, far array<string>, texts array<string>, few array<string>, many array<string>")
def name_classes(names: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    text = lambda x: None if x is None or x != x else x
    rows = [name_class(text(n) or "", text(k)) for n, k in zip(names, kinds)]
    return pd.DataFrame(rows, columns=["node", "looks", "index", "near", "far", "texts", "few", "many"])


@arrow_udf("match boolean, score double, reason string")
def name_match(a: pd.Series, a_kind: pd.Series, b: pd.Series, b_kind: pd.Series) -> pd.DataFrame:
    text = lambda x: None if x is None or x != x else x
    rows = [match(text(x) or "", text(k), text(y) or "", text(m)) for x, k, y, m in zip(a, a_kind, b, b_kind)]
    return pd.DataFrame(rows, columns=["match", "score", "reason"])


@arrow_udf("array<string>")
def index_tokens(names: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([index_keys(n or "", bucket(k)) for n, k in zip(names, kinds)], dtype=object)


@arrow_udf("array<string>")
def lookup_tokens(names: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([lookup_keys(n or "", bucket(k)) for n, k in zip(names, kinds)], dtype=object)


@arrow_udf("int")
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y, max(len(x), len(y))) for x, y in zip(a, b)], dtype="Int32")
