"""Variant spellings of names linked to the person or organisation meant (problem 1).

Noisy-channel attribution. Spellings are folded and parsed to forms: for a person the
family name, given name or initial and middle initial, for an organisation its own name
and the other words without legal form. Forms are ranked by how often they occur; a form
is attached to the canonical form of the greatest posterior, the product of the frequency
prior and the likelihoods of typos, nicknames, initials and abbreviations, unless a new
entity of that name is more likely. Family and own names with typos are brought together
by one-deletion neighbourhoods, so that only near names are ever compared.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mnemograph.operators.components import connected_components
from mnemograph.session import cut, unpriced

# fixed values: words around names
TITLES = "dr doctor prof professor rev reverend hon mr mrs ms miss sir dame lord lady mayor judge capt captain col".split()
SUFFIXES = "phd md esq esquire emeritus emerita jr sr dds ret".split()
STOP_WORDS = "of for the and at in de der die das und fur la le et y".split()
LEGAL_FORMS = (
    "inc incorporated corp corporation co company ltd limited gmbh gesellschaft mbh ag aktiengesellschaft plc sa llc llp lp nv bv kg se spa oy ab"
).split()
SAME_WORDS = {"banking": "bank", "universitat": "university", "universidad": "university", "universite": "university"}
LETTERS = {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}
# fixed values: short forms of given names
NICKNAMES = {
    "abigail": "abby gail", "alexander": "alex alec xander sandy", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony",
    "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate katie", "charles": "charlie chuck chas", "christine": "chris tina",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don donnie",
    "dorothy": "dot dottie dolly", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie", "frederick": "fred freddy",
    "gregory": "greg", "henry": "harry hank", "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon",
    "joseph": "joe joey jo", "josephine": "jo josie", "katherine": "kate kathy katie kay", "kenneth": "ken", "lawrence": "larry",
    "margaret": "peggy maggie meg", "matthew": "matt", "michael": "mike mick", "nicholas": "nick", "patricia": "pat trish patty tricia",
    "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rick dick rich", "robert": "bob rob bobby",
    "ronald": "ron", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "theodore": "theo ted", "thomas": "tom tommy",
    "timothy": "tim", "victoria": "vicky", "walter": "walt", "william": "bill will billy", "zachary": "zack zach",
}
_FULL = {}
for _name, _short in NICKNAMES.items():
    for _nick in _short.split():
        _FULL.setdefault(_nick, []).append(_name)

# probabilities of the channel
P_NEW, P_NICKNAME, P_INITIAL, P_NO_GIVEN, P_NO_MIDDLE, P_ABBREVIATION, P_TYPO = 0.2, 0.1, 0.15, 0.03, 0.3, 0.15, 0.04
EDITS_OF_GIVEN, EDITS_OF_CORE = 100.0, 300.0
MIN_TYPO_LENGTH = 5
#: a spelling of a given name that occurs up to this share of a near one is taken for its typo
RARE_TYPO = 0.03
#: chance that a written form that need not be one is a name of its own: an initial, a rare
#: spelling of a near given name, the same given name once more, the words of an organisation
#: with this own name in short
P_OWN = 1e-9
TOKENS = "struct<before:array<string>,after:array<string>>"
PARSED = "array<struct<core:string,given:string,middle:string,bag:string,own:boolean,extra:boolean>>"


def fold(name: str) -> str:
    """Lower case without accents; everything but letters, digits and commas is a space.

    A name written as one word is cut where a capital follows a small letter.
    """
    name = name.replace("_", " ")
    if re.fullmatch(r"\w*[^\W\d_A-Z][A-Z]\w*", re.sub(r"[.&-]", "", name.strip())):
        name = re.sub(r"(?<=[^\W\d_])(?<=[^A-Z])(of|for|and)(?=[A-Z])", r" \1 ", name)
        name = re.sub(r"(?<=[^\W\d_])(?<=[^A-Z])(?=[A-Z])", " ", name)
    text = "".join(LETTERS.get(c, c) for c in name.lower())
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r",?\s*\(?\b(?:ph\W?\s?d|m\.\s?d)\b\.?\)?\s*$", " ", text)
    return re.sub(r"[^\w,]", " ", text.replace("'", "").replace("’", ""))


def _joined_letters(words: list[str]) -> list[str]:
    """Legal forms written as letters (s a, g m b h) as one word."""
    out: list[str] = []
    i = 0
    while i < len(words):
        j = i
        while j < len(words) and len(words[j]) == 1:
            j += 1
        if j - i > 1 and "".join(words[i:j]) in LEGAL_FORMS:
            out.append("".join(words[i:j]))
        else:
            out.extend(words[i:j])
        if j < len(words):
            out.append(words[j])
        i = j + 1
    return out


def tokens_of(kind: str, name: str) -> dict:
    """Words before and behind the comma; for an organisation all are before."""
    parts = [p.split() for p in fold(name).split(",")]
    if kind == "person":
        parts = [[w for w in p if w not in TITLES and w not in SUFFIXES] for p in parts]
        parts = [p for p in parts if p]
        return {"before": parts[0] if parts else [], "after": [w for p in parts[1:] for w in p]}
    words = _joined_letters([w for p in parts for w in p])
    kept = [SAME_WORDS.get(w, w) for w in words if w not in LEGAL_FORMS and w not in STOP_WORDS]
    return {"before": kept or words, "after": []}


def _person(words: list, comma: bool) -> list[dict]:
    """words: (side, place, word, times behind a comma, times before one, spellings).

    Where neither word, or both, are known as given names, both readings are forms; the
    wrong one has no like.
    """
    long = [w for w in words if len(w[2]) > 1]
    initials = [w[2] for w in words if len(w[2]) == 1]
    if not long:
        return []
    if comma and any(w[0] == 0 for w in long):
        family = [w for w in long if w[0] == 0]
        rest = [w for w in long if w[0] == 1]
        core, given = " ".join(w[2] for w in family), rest[0][2] if rest else ""
        extra = [w[2][0] for w in rest[1:]]
    elif len(long) == 1:
        core, given, extra = long[0][2], "", []
    else:
        known = lambda w: w[3] >= 3 and w[3] > 3 * w[4]
        first, last = long[0], long[-1]
        both = [(last, first), (first, last)]  # (family name, given name) as written or turned
        if known(first) != known(last):
            both = both[:1] if known(first) else both[1:]
        extra = [w[2][0] for w in long[1:-1]]
        middle = (extra + initials + [""])[0]
        return [{"core": c[2], "given": g[2], "middle": middle, "bag": "", "own": False, "extra": False} for c, g in both]
    if not given and initials:
        given, initials = initials[0], initials[1:]
    middle = (extra + initials + [""])[0]
    return [{"core": core, "given": given, "middle": middle, "bag": "", "own": False, "extra": False}]


def _organisation(words: list) -> list[dict]:
    """Forms of the rarest word and of the own name; every other word may be the own name as well.

    The own name is the word with the fewest kinds of other words beside it. A rarest word
    that is not may be a slip, and so the rest are ``extra`` forms, which are looked up among own names only.
    """
    ranked = sorted(words, key=lambda w: (w[5], -len(w[2]), w[2]))
    own = min(ranked, key=lambda w: w[6])[2]
    out = {}
    for k, core in enumerate(w[2] for w in ranked):
        bag = sorted(w[2] for w in words if w[2] != core)
        out.setdefault(core, {"core": core, "given": "", "middle": "", "bag": " ".join(bag), "own": core == own, "extra": k > 0 and core != own})
    return list(out.values())


def one_edit(a: str, b: str) -> bool:
    """One letter inserted, deleted, replaced, or two neighbours exchanged."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def abbreviates(short: str, word: str) -> bool:
    """A shorter word with the same first letter whose letters occur in order."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _given_channel(f: str, g: str) -> float | None:
    """log P(f was written | the given name is g), without the share of the initial g."""
    if f == g:
        return 0.0
    if not f:
        return math.log(P_NO_GIVEN)
    if len(f) == 1:
        return math.log(P_INITIAL) if f == g[0] or any(f == n[0] for n in NICKNAMES.get(g, "").split()) else None
    if g in _FULL.get(f, ()):
        return math.log(P_NICKNAME)
    if f in _FULL.get(g, ()):
        return math.log(P_NICKNAME / 4)
    if set(_FULL.get(f, ())) & set(_FULL.get(g, ())):
        return math.log(P_NICKNAME * P_NICKNAME)
    if min(len(f), len(g)) >= 3 and one_edit(f, g):
        return math.log(P_TYPO / EDITS_OF_GIVEN)
    for full in _FULL.get(f, ()):  # a nickname of a name written with a typo
        if one_edit(full, g) and len(g) >= MIN_TYPO_LENGTH:
            return math.log(P_NICKNAME * P_TYPO / EDITS_OF_GIVEN)
    return None


def _bag_channel(f: str, g: str) -> float | None:
    """log P(f's words were written | g's words), each word of one matched to one of the other."""
    a, b = f.split(), g.split()
    if len(a) != len(b):
        return None
    total, left = 0.0, list(b)
    for exact in (True, False):
        for word in list(a):
            if exact and word in left:
                left.remove(word)
                a.remove(word)
            elif not exact:
                options = [(math.log(P_ABBREVIATION), w) for w in left if abbreviates(word, w)]
                options += [(math.log(P_TYPO / EDITS_OF_GIVEN), w) for w in left if len(w) > 3 and one_edit(word, w)]
                if not options:
                    return None
                cost, w = max(options)
                left.remove(w)
                total += cost
    return total


def _channel(kind: str, fg: str, gg: str, fm: str, gm: str, fb: str, gb: str) -> float | None:
    if kind != "person":
        return _bag_channel(fb, gb)
    if (fm and gm and fm != gm) or (len(fg) > 1 and fm and not gm) or (len(gg) < 2 and (fg != gg or (fm and not gm))):
        return None
    given = _given_channel(fg, gg)
    if given is None:
        return None
    return given + (math.log(P_NO_MIDDLE) if gm and not fm else math.log(1 - P_NO_MIDDLE))


@F.pandas_udf(DoubleType())
def _likelihood(kind: pd.Series, fg: pd.Series, gg: pd.Series, fm: pd.Series, gm: pd.Series, fb: pd.Series, gb: pd.Series) -> pd.Series:
    return pd.Series([_channel(*x) for x in zip(kind, fg, gg, fm, gm, fb, gb)], dtype="float64")


def _deletions(word: Column) -> Column:
    """The word and all that is left of it without one letter."""
    n = F.length(word)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cuts))


def _neighbours(cores: DataFrame, least: int) -> DataFrame:
    """(kind, core, near): names one edit, or one moved letter, apart; and each with itself.

    Names of fewer than ``least`` letters are near to themselves only.
    """
    long = cores.where(F.length("core") >= least)
    keyed = long.select("kind", "core", F.explode(_deletions(F.col("core"))).alias("key"))
    other = keyed.select("kind", F.col("core").alias("near"), "key")
    pairs = unpriced(keyed).join(other, ["kind", "key"]).where(F.col("core") != F.col("near")).select("kind", "core", "near").distinct()
    distance = F.levenshtein("core", "near", 2)
    moved = (distance == 2) & (F.array_sort(F.split("core", "")) == F.array_sort(F.split("near", "")))
    return pairs.where((distance == 1) | moved).unionByName(cores.select("kind", "core", F.col("core").alias("near")))


def _letter_model(cores: DataFrame) -> np.ndarray:
    """log P(letter | letter before) over all names; letters beyond a-z count as one. Of fixed size."""
    padded = F.concat(F.lit("^"), F.regexp_replace("core", "[^a-z]", "?"), F.lit("$"))
    pairs = cores.select(padded.alias("w")).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    letters = "^$?abcdefghijklmnopqrstuvwxyz"
    counts = np.full((len(letters), len(letters)), 0.05)
    for row in pairs.groupBy("p").count().collect():
        counts[letters.index(row.p[0]), letters.index(row.p[1])] += row["count"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def _log_word(model: np.ndarray):
    @F.pandas_udf("double")
    def score(words: pd.Series) -> pd.Series:
        letters = "^$?abcdefghijklmnopqrstuvwxyz"
        place = {c: i for i, c in enumerate(letters)}

        def one(word: str) -> float:
            at = [0] + [place.get(c, 2) if c not in "^$" else 2 for c in word] + [1]
            return float(model[at[:-1], at[1:]].sum())

        return words.map(one)

    return score


def spelled_forms(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, spelling) of every entity with a name, and (spelling, kind, form, ...) of each spelling."""

    @F.pandas_udf(TOKENS)
    def tokenise(kinds: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tokens_of(k, n) for k, n in zip(kinds, names)], columns=["before", "after"])

    split = entities.select("entity_id", "kind", tokenise.asNondeterministic()("kind", "name").alias("t"))
    spelling = F.concat_ws("|", "kind", F.array_join("t.before", " "), F.array_join("t.after", " "))
    spelled = cut(split.select("entity_id", "kind", spelling.alias("spelling"), "t.before", "t.after"))
    spellings = spelled.groupBy("spelling").agg(F.first("kind").alias("kind"), F.first("before").alias("before"), F.first("after").alias("after"))
    comma = F.size("after") > 0
    side = lambda name, k: F.transform(F.col(name), lambda w, i: F.struct(F.lit(k).alias("side"), i.alias("place"), w.alias("word")))
    words = cut(spellings.select("spelling", "kind", comma.alias("comma"), F.explode(F.concat(side("before", 0), side("after", 1))).alias("w")).select("spelling", "kind", "comma", "w.*"))
    stats = words.groupBy("kind", "word").agg(
        F.sum(F.when(F.col("comma") & (F.col("side") == 1), 1).otherwise(0)).alias("behind"),
        F.sum(F.when(F.col("comma") & (F.col("side") == 0), 1).otherwise(0)).alias("ahead"),
        F.count(F.lit(1)).alias("spellings"),
    )
    # other words beside a word of an organisation: of one first and last letter, which slips and short forms mostly keep, they count once
    of_organisation = words.where("kind <> 'person'").select("spelling", "kind", "word").distinct()
    other = of_organisation.select("spelling", F.col("word").alias("other"))
    ends = F.concat(F.substring("other", 1, 1), F.substring("other", -1, 1))
    beside = of_organisation.join(other, "spelling").where(F.col("word") != F.col("other")).groupBy("kind", "word").agg(F.countDistinct(ends).alias("beside"))
    stats = stats.join(beside, ["kind", "word"], "left").fillna(0, ["beside"])
    gathered = words.join(stats, ["kind", "word"]).groupBy("spelling", "kind", "comma").agg(F.array_sort(F.collect_list(F.struct("side", "place", "word", "behind", "ahead", "spellings", "beside"))).alias("words"))

    @F.pandas_udf(PARSED)
    def parse(kinds: pd.Series, commas: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for kind, comma, ws in zip(kinds, commas, words):
            rows = [tuple(w.values()) for w in ws]
            out.append(_person(rows, comma) if kind == "person" else _organisation(rows))
        return pd.Series(out)

    parsed = gathered.select("spelling", "kind", F.explode(parse.asNondeterministic()("kind", "comma", "words")).alias("p")).select("spelling", "kind", "p.*")
    form = F.concat_ws("|", "kind", "core", "given", "middle", "bag")
    return spelled.select("entity_id", "spelling"), cut(parsed.withColumn("form", form))


def linked_names(entities: DataFrame, kinds: tuple[str, ...] = ("person", "organization"), min_posterior: float = 0.6, min_typo_length: int = MIN_TYPO_LENGTH) -> DataFrame:
    """(entity_id, entity_type, spelling, group_id): entities whose names mean the same share a group.

    An entity counts with its latest delivery (by ``updated_time``); null ids, types other
    than ``kinds``, and names that are null or without letters are left out. The group is
    named by a spelling. A form is attached to the canonical form of greatest posterior,
    against its rivals and against being a name of its own, where that is at least
    ``min_posterior``; else it stays for itself. Family and own names of fewer than
    ``min_typo_length`` letters are not compared for typos. An empty table gives an empty
    result.
    """
    latest = entities.where("entity_id is not null").groupBy("entity_id").agg(
        F.max_by(F.struct("name", F.col("entity_type").alias("kind")), F.coalesce("updated_time", F.lit("1000-01-01").cast("timestamp_ntz"))).alias("e")
    )
    named = latest.select("entity_id", "e.*").where(F.col("kind").isin(*kinds) & F.col("name").isNotNull())
    spelled, every_form = spelled_forms(named)
    spellings = every_form.where("not extra")
    counted = spelled.join(spellings, "spelling").groupBy("form", "kind", "core", "given", "middle", "bag").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    totals = counted.groupBy("kind").agg(F.sum("n").alias("total"))
    by_core = counted.groupBy("kind", "core").agg(F.sum("n").alias("core_n"))
    by_given = counted.groupBy("kind", "given").agg(F.sum("n").alias("given_n"))
    cores = by_core.select("kind", "core")
    near = _neighbours(cores, min_typo_length)
    log_word = _log_word(_letter_model(cores))
    enriched = counted.join(by_core, ["kind", "core"]).join(by_given, ["kind", "given"]).join(F.broadcast(totals.limit(len(kinds))), "kind")
    # nodes of the graph are numbers: even ones for forms, odd ones for spellings
    forms = cut(enriched.withColumns({"log_core": log_word("core"), "id": 2 * F.monotonically_increasing_id()}))
    named_nodes = cut(spellings.select("spelling").distinct().withColumn("node", 2 * F.monotonically_increasing_id() + 1))

    # keys by which a form and its canonical candidates meet, beside the near core
    person = F.col("kind") == "person"
    initials = F.array_join(F.array_sort(F.transform(F.split("bag", " "), lambda w: F.substring(w, 1, 1))), "")
    full = F.length("given") > 1
    nick_map = F.create_map(*[F.lit(x) for nick, names in _FULL.items() for x in (nick, " ".join(names))])
    expansions = F.coalesce(F.try_element_at(nick_map, F.col("given")), F.lit(""))
    all_given = F.filter(F.concat(F.array("given"), F.split(expansions, " ")), lambda x: x != "")
    spelled_given = F.flatten(F.transform(all_given, _deletions))
    first_letters = F.transform(all_given, lambda g: F.concat(F.lit("="), F.substring(g, 1, 1)))
    nick_letters = F.create_map(*[F.lit(x) for name, nicks in NICKNAMES.items() for x in (name, " ".join(sorted({n[0] for n in nicks.split()})))])
    more_letters = F.transform(F.filter(F.split(F.coalesce(F.try_element_at(nick_letters, F.col("given")), F.lit("")), " "), lambda x: x != ""), lambda c: F.concat(F.lit("="), c))
    canonical_keys = F.when(person, F.when(full, F.concat(spelled_given, first_letters, more_letters, F.array(F.lit("*")))).when(F.length("given") == 1, F.array(F.concat(F.lit("="), "given"))).otherwise(F.array(F.lit("*")))).otherwise(F.array(F.concat(F.lit("#"), initials)))
    form_keys = F.when(person, F.when(full, spelled_given).when(F.length("given") == 1, F.array(F.concat(F.lit("="), "given"))).otherwise(F.array(F.lit("*")))).otherwise(F.array(F.concat(F.lit("#"), initials)))

    # only hashes of keys and numbers of forms are shuffled and joined; what met is fetched after
    key_hash = lambda core: F.xxhash64("kind", core, "key")
    g = forms.select("id", "kind", "core", F.explode(F.array_distinct(canonical_keys)).alias("key")).select(F.col("id").alias("g_id"), key_hash("core").alias("key"))
    keyed = forms.select("id", "kind", "core", F.explode(F.array_distinct(form_keys)).alias("key"))
    f = keyed.join(unpriced(near), ["kind", "core"]).select("id", key_hash("near").alias("key"))
    ids = f.join(unpriced(g), "key").where(F.col("id") != F.col("g_id")).select("id", "g_id").distinct()
    canonical = forms.select(F.col("id").alias("g_id"), F.col("core").alias("near"), *(F.col(c).alias(f"g_{c}") for c in ("form", "given", "middle", "bag", "n", "core_n", "given_n")))
    met = ids.join(unpriced(forms), "id").join(unpriced(canonical), "g_id")
    likely = met.withColumn("channel", _likelihood("kind", "given", "g_given", "middle", "g_middle", "bag", "g_bag")).where("channel is not null")

    # a form is a spelling of a canonical form, or a new bearer of its own name, or a new name
    same_core = F.col("core") == F.col("near")
    same_words = F.when(person, F.col("given") == F.col("g_given")).otherwise(F.lit(True))
    rare = F.col("given_n") <= F.greatest(F.lit(2), F.lit(RARE_TYPO) * F.col("g_given_n"))  # hardly a name of its own
    own = F.when(same_words | (F.length("given") < 2) | rare, F.log(F.lit(P_OWN))).otherwise(0.0)
    given_share = F.log(F.col("given_n") / F.col("total"))
    at_same = F.log(F.col("g_n") / F.col("g_core_n")) + F.col("channel")
    new_bearer = F.log(F.lit(P_NEW)) + given_share + own
    slip = F.log(F.lit(P_TYPO / EDITS_OF_CORE)) + F.log(F.col("g_core_n") / F.col("total"))  # the name was meant and mistyped
    new_name = F.log(F.lit(P_NEW)) + F.col("log_core") + F.when(person, given_share).otherwise(0.0)
    score = F.when(same_core, at_same).otherwise(at_same + slip)
    new = F.when(same_core, F.exp(new_bearer)).otherwise(F.exp(new_bearer + slip) + F.exp(new_name))
    partly = person & (F.length("given") < 2)
    scored = cut(likely.select("id", "g_id", "g_form", "g_middle", score.alias("score"), new.alias("new"), same_core.alias("same"), partly.alias("partial")).where(F.exp("score") > F.col("new")))

    # first forms with a full given name, and organisations: the best of the same and the best of a near own name, where
    # it has the posterior against a new bearer and against rivals of another middle initial, of which there are few
    by_middle = scored.where(~F.col("partial")).groupBy("id", "same", "g_middle").agg(F.sum(F.exp("score")).alias("mass"), F.min(F.struct((-F.col("score")).alias("cost"), "g_form", "g_id", "new")).alias("top"))
    entries = by_middle.groupBy("id", "same").agg(F.min(F.struct("top.cost", "top.g_form", "top.g_id", "top.new", "g_middle")).alias("best"), F.collect_list(F.struct("g_middle", "mass")).alias("middles"))
    rivals = F.filter("middles", lambda x: (x.g_middle != F.col("best.g_middle")) & (x.g_middle != "") & (F.col("best.g_middle") != ""))
    against = F.aggregate(rivals, F.col("best.new"), lambda a, x: a + x.mass)
    chance = F.exp(-F.col("best.cost"))
    attached = entries.where(chance / (chance + against) >= min_posterior).select(F.col("id").alias("u"), F.col("best.g_id").alias("v"))
    one_spelling = spellings.select("form", "spelling").join(unpriced(forms.select("form", "id")), "form").join(unpriced(named_nodes), "spelling").select(F.col("id").alias("u"), F.col("node").alias("v"))
    # a slip may be the rarest word of an organisation: by any other word, where that is the own name of the form meant
    own = forms.join(spellings.where("own").select("form").distinct(), "form", "left_semi").select("core", F.concat(F.lit("#"), initials).alias("key"), *(F.col(c).alias(f"g_{c}") for c in ("id", "form", "bag", "n", "core_n")))
    slipped = every_form.where("extra").select("spelling", "core", F.concat(F.lit("#"), initials).alias("key"), "bag").join(own, ["core", "key"])
    empty, organisation = F.lit(""), F.lit("organization")
    meant = slipped.withColumn("channel", F.greatest(*(_likelihood(organisation, empty, empty, empty, empty, *bags) for bags in (("bag", "g_bag"), ("g_bag", "bag"))))).where("channel is not null")
    cost = F.log(F.col("g_core_n") / F.col("g_n")) - F.col("channel")
    by_others = meant.groupBy("spelling").agg(F.min(F.struct(cost.alias("cost"), "g_form", "g_id")).alias("best")).join(unpriced(named_nodes), "spelling").select(F.col("node").alias("u"), F.col("best.g_id").alias("v"))
    bound = cut(attached.unionByName(one_spelling).unionByName(by_others))
    groups = cut(connected_components(bound, "u", "v"))

    # then forms of an initial or a family name only: the posterior of a group is that of its forms together
    partial = scored.where("partial").join(unpriced(groups.select(F.col("node").alias("g_id"), F.col("component").alias("meant"))), "g_id")
    by_group = partial.groupBy("id", "same", "meant").agg(F.sum(F.exp("score")).alias("mass"), F.max(F.struct("score", "g_form")).alias("top"))
    chosen = by_group.groupBy("id", "same").agg(F.sum("mass").alias("all"), F.max(F.struct("mass", "top.g_form", "meant")).alias("best"))
    late = chosen.where(F.col("best.mass") / F.col("all") >= min_posterior).select(F.col("id").alias("node"), F.col("best.meant").alias("meant"))
    # only the groups that are joined by these forms are contracted once more
    merged = connected_components(late.join(unpriced(groups), "node").select("component", "meant"), "component", "meant")
    joined = groups.join(unpriced(merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))), "component", "left")
    of_spelling = joined.select("node", F.coalesce("whole", "component").alias("number")).join(unpriced(named_nodes), "node").select("spelling", "number")
    first = of_spelling.groupBy("number").agg(F.min("spelling").alias("group_id"))
    of_spelling = of_spelling.join(unpriced(first), "number").select("spelling", "group_id")
    kinds_of = spellings.select("spelling", F.col("kind").alias("entity_type")).distinct()
    return spelled.join(unpriced(of_spelling), "spelling").join(unpriced(kinds_of), "spelling").select("entity_id", "entity_type", "spelling", "group_id")
