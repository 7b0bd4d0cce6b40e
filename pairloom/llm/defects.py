"""Broken prompt and response pairs: clauses tagged by a conditional random field, coverage turned into defects.

A response is cut into clauses. Each is described by its words and word pairs, its place, whether the turns of the case
contain it word for word, whether the response is in another language than the turns and none of them asks for that
language, and whether the text stops at it. A linear-chain field tags every clause as answer, refusal, echo, foreign or
unfinished; neighbours decide about clauses that say little themselves, such as courtesies. The share of words under a
tag then gives at most one defect:

empty     null, or nothing said (decided before tagging)
copy      echo covers `copied` of the words, and the last clause
refusal   refusal covers `refused` of the words
language  foreign covers `foreign` of the words
truncated the last clause is unfinished

The field is fitted on all answers, whose clauses are labelled: echoes by containment, foreign clauses by the language of
function words, unfinished ones by the classifier of endings. No refusal is known by its wording. Clauses that deny talking or
helping, in the speaker's own name or that of a role, are the first refusals; others are learnt from the company they keep
(see `refusals`); and the field learns from both what refusals are made of. Answers are described once (`describe`); what is
counted, learnt and decided from then on is read from the descriptions, and every step of the fit sums over all of them.

Defined cases: null responses are empty; a case without turns, or unknown, has no language and nothing to copy; an
answer delivered again counts once, by its first delivery; models with null names cannot occur (map keys).
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from functools import cache, lru_cache, reduce
from itertools import chain, repeat
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import crf
from pairloom.llm.crf import flat
from pairloom.llm.endings import INCOMPLETE, ITEM, SENTENCE, TERMINAL, Endings, shape_of
from pairloom.llm.truncation import answers, deliveries, first_only, fit_endings, limits, mark_limits, says_nothing
from pairloom.llm.words import WORD, words
from pairloom.session import materialize, small

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL_TAG, ECHO, FOREIGN, UNFINISHED = range(5)

LANGUAGES = ("en", "de", "fr", "es")

#: Frequent function words and short replies of each language.
FUNCTION_WORDS = {
    "en": "the of and to is you i we for with that it on my your can could would please was at a an are this be have has in by if so will not what which how does do there any from or but no yes sorry sold out me our us as than then been here i'm let's".split(),
    "de": "der die das und ist ich wir sie nicht mit für zu ein eine einen einem einer auf dem den des ihr ihre ihnen uns wird kann bitte nach im noch auch es so von bei heute etwas kein keine keinen dazu schon darf gern leider nein ja minuten über statt oder aber sich mir mich hat gibt wie was warum euro dass vor bis an am zum zur gegen".split(),
    "fr": "le la les et est je nous vous pas avec pour un une des du de à en sur votre que peut sans au aux il elle ne ce se qui cela ça mon ma mes sa son ses y oui hélas non combien très bien merci dans nos notre suis sont par plus mais où été désirez l d j c qu n s".split(),
    "es": "el la los las y es yo usted no con para un una de del en que su sus por le les al sin como puede hay lo se nos mi me muy más pero sí desgracia minutos cuesta esto está son hoy si qué cuál este esta ya o a gracias euros podemos algo".split(),
}

#: Names of the languages, as they stand in requests to answer in them.
ASKED = {
    "en": r"\b(?:in|into|to)\s+english|\ben\s+(?:anglais|inglés)|\bauf\s+englisch|\binglese",
    "de": r"\b(?:in|into|to)\s+german|\ben\s+(?:allemand|alemán)|\bauf\s+deutsch",
    "fr": r"\b(?:in|into|to)\s+french|\ben\s+(?:français|francés)|\bauf\s+französisch",
    "es": r"\b(?:in|into|to)\s+spanish|\ben\s+(?:espagnol|español|castellano)|\bauf\s+spanisch",
}
#: Parts of those names: a text without any need not be searched.
STEMS = ("engl", "anglais", "ingl", "german", "allemand", "alem", "deutsch", "french", "français", "franc", "französ", "spanish", "espa", "castellano", "spanisch")
ASKED_RE = {k: re.compile(v, re.IGNORECASE) for k, v in ASKED.items()}

#: What a refusal speaks of, by the beginnings of words; no sentences. Denial, talking or helping, the
#: speaker's role and rules, unwillingness, and words that point at what was asked without naming it.
DENIAL = "not cannot can't cant won't don't unable never no nobody refuse refusing declin nicht kein nichts ablehn lehne verweiger ne n pas rien aucun refus interdi no nada nunca ningun ningún imposible niego negar rechaz impid prevent forbid".split()
TALK = "answer ask repl respon discuss talk comment speak say help assist advi inform conversation topic subject question request engag particip act chat antwort beantwort helf hilfe auskunft sag sprech spreche gespräch unterhalt thema frag äußer stellung répon aid dire parl convers sujet question demand commentair prononc avis respuest respond ayud habl tema pregunt contest petición opin coment decir asunto".split()
ROLE = "ai model guideline polic rule permitt allow appropriat comfortabl scope role duties competen sprachmodell textmodell modell ki richtlinie vorgabe regel rolle zuständig befug modèle ia consigne règle rôle politique convenabl mission modelo norma regla política papel apropiad función".split()
WILL = "prefer rather möchte lieber préfèr souhait prefier quier".split()
POINTING = "this that here there it such darauf dazu davon das dies diese diesem dieser dieses hier cela ça là eso esto ello este esta".split()
SPEAKER = "i me my ich mir mich mein meine je j me m moi mon mes yo me mi mis nos debo puedo quiero tengo voy".split()
WHOLE = frozenset("not cannot no ne n pas rien act ai ki ia sag dire avis decir say".split())  # words as they are, not beginnings
KINDS = ("denial", "talk", "role", "will", "pointing", "speaker")


def beginnings(listed: list[str]) -> re.Pattern[str]:
    return re.compile("|".join(re.escape(w) + (r"\Z" if w in WHOLE or len(w) <= 2 else "") for w in sorted(set(listed), key=lambda w: (-len(w), w))))


LEXICON = [*map(beginnings, (DENIAL, TALK, ROLE, WILL)), *(re.compile(rf"(?:{'|'.join(x)})\Z") for x in (POINTING, SPEAKER))]
DENIAL_BIT, TALK_BIT, ROLE_BIT, WILL_BIT = 1, 2, 4, 8
PART = re.compile(r"[,;:–—]\s")
EINGEHEN = re.compile(r"\bgeh\w*\b[^,;]*\bein\W*$")  # a verb whose parts stand apart
SHORT_NOT = frozenset("don can won isn aren wasn doesn didn couldn wouldn shouldn mustn".split())  # before n't


class TokenBits(dict):
    """What a word speaks of, kept by each worker for as many as 2^16 words."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[token] = bits = sum(1 << k for k, x in enumerate(LEXICON) if x.match(token))
        return bits


TOKEN_BITS = TokenBits()


def bits_of(tokens: list[str]) -> int:
    out = reduce(or_, map(TOKEN_BITS.__getitem__, tokens), 0)
    if "t" in tokens and any(b == "t" and a in SHORT_NOT for a, b in zip(tokens, tokens[1:])):
        out |= DENIAL_BIT
    return out


def spoken_of(part: str, tokens: list[str]) -> int:
    """Bits of what a clause speaks of, and those of what one of its parts between commas denies."""
    return denied_in(part, bits_of(tokens))


def denied_in(part: str, out: int) -> int:
    if not out & DENIAL_BIT:
        return out
    pieces = PART.split(part)
    for piece in pieces:
        said = out if len(pieces) == 1 else bits_of(words(piece))
        if said & DENIAL_BIT:
            out |= DENIED | (NO_TALK if said & TALK_BIT or ("geh" in piece and EINGEHEN.search(piece)) else 0) | (NO_WILL if said & WILL_BIT else 0)
    return out


DENIED, NO_TALK, NO_WILL = (1 << len(KINDS) + k for k in range(3))


def refuses(said: int) -> bool:
    """The evidence by which clauses are taken for refusals at first, if they say nothing of their case."""
    has = lambda *kinds: all(said >> KINDS.index(k) & 1 for k in kinds)
    if said & NO_TALK:
        return has("speaker") or has("role") or has("pointing")
    return bool(said & DENIED and (has("role", "speaker") or (said & NO_WILL and has("pointing")))) or has("role", "talk", "denial")


BASE = ("bias", "first", "last", "only", "question", "colon", "before_echo", "short", "long", "echo", "echo_short", "other_language", "same_language", "no_language", "asked_language", "cut", "quoted", "of_case", "no_talk", "no_will", "denied", "role_talk", "refuses", *KINDS)
B = {name: i for i, name in enumerate(BASE)}
MARK = {name: 1 << i for name, i in B.items()}  # a clause's features, but for its words, are bits of one number
TOPIC = 1 << len(BASE)  # no feature: the clause says something of its case
DIRECT = ("echo", "before_echo", "other_language", "cut", "refuses")  # speak for one tag each; what they weigh is learnt


def language_table() -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for k, name in enumerate(LANGUAGES):
        for w in FUNCTION_WORDS[name]:
            for part in WORD.findall(w):
                out.setdefault(part, np.zeros(len(LANGUAGES), np.int32))[k] = 1
    return out


LANE = 24
LANGUAGE_CODES = {w: sum(int(x) << (LANE * k) for k, x in enumerate(v)) for w, v in language_table().items()}


def packed(tokens: list[str]) -> int:
    """Counts of each language's function words, in lanes of one number."""
    return sum(map(LANGUAGE_CODES.get, tokens, repeat(0)))


class TokenSums(dict):
    """Of a word, what `packed` counts and, in lanes above, what it speaks of; kept by each worker for as many as 2^16 words."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        bits = TOKEN_BITS[token]
        self[token] = out = LANGUAGE_CODES.get(token, 0) + sum(1 << (LANE * (len(LANGUAGES) + k)) for k in range(len(KINDS)) if bits >> k & 1)
        return out


TOKEN_SUMS = TokenSums()
COUNTS = (1 << LANE * len(LANGUAGES)) - 1


@lru_cache(1 << 14)
def some(counts: int) -> int:
    """A bit for each lane that isn't 0."""
    return sum(1 << k for k in range(len(KINDS)) if counts >> (LANE * k) & ((1 << LANE) - 1))


def told_by(tokens: list[str]) -> tuple[int, int]:
    """`packed` and `bits_of` at once."""
    total = sum(map(TOKEN_SUMS.__getitem__, tokens))
    bits = some(total >> LANE * len(LANGUAGES))
    if "t" in tokens and any(b == "t" and a in SHORT_NOT for a, b in zip(tokens, tokens[1:])):
        bits |= DENIAL_BIT
    return total & COUNTS, bits


def lanes(counts: int) -> list[int]:
    return [counts >> (LANE * k) & ((1 << LANE) - 1) for k in range(len(LANGUAGES))]


def ahead(n: int, other: int) -> bool:
    return n - other >= 2 and n >= 1.3 * other


def leading(counts: int, n_tokens: int) -> int:
    """The language whose function words lead clearly, else -1."""
    total = lanes(counts)
    best = max(range(len(LANGUAGES)), key=total.__getitem__)
    top = total[best]
    total[best] = -1
    next_best = max(total)
    if ahead(top, next_best):
        return best
    return best if top >= 1 and n_tokens <= 4 and not next_best else -1


def language(tokens: list[str]) -> int:
    return leading(packed(tokens), len(tokens))


@lru_cache(1 << 14)
def spoken(counts: int, n_tokens: int, lang: int, asked: int) -> str:
    """The feature that says how a text's language stands to its case's. Other languages share words (la, de, un), so
    one must lead the case's clearly, and another of them only where the turns ask for that."""
    best = leading(counts, n_tokens) if lang >= 0 else -1
    if best >= 0:
        return "same_language" if best == lang else "asked_language" if asked >> best & 1 else "other_language"
    if lang < 0:
        return "no_language"
    total = lanes(counts)
    others = [k for k in range(len(LANGUAGES)) if k != lang]
    top = max(total[k] for k in others)
    if not ahead(top, total[lang]):
        return "no_language"
    wanted = [total[k] for k in others if asked >> k & 1]
    return "asked_language" if wanted and not ahead(top, max(wanted)) else "other_language"


def clauses(text: str) -> list[str]:
    """Sentences of the lines of a text."""
    out: list[str] = []
    for line in text.split("\n"):
        out += [c for c in SENTENCE.split(line) if c and not c.isspace()]
    return out


def asked_for(text: str) -> int:
    """The languages asked for, as bits."""
    low = text.lower()
    if not any(stem in low for stem in STEMS):
        return 0
    return sum(1 << k for k, name in enumerate(LANGUAGES) if ASKED_RE[name].search(low))


def normal(tokens: list[str]) -> str:
    return f" {' '.join(tokens)} "


def case_facts(cases: DataFrame) -> DataFrame:
    """case_key, the turns' words, their language and the languages asked for (bits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told_by, langs, asked = [], [], []
            for turns in batch.column(1).to_pylist():
                told = [words(t) for t in turns or () if t]
                told_by.append("|".join(normal(t) for t in told))
                langs.append(language([w for t in told for w in t]))
                asked.append(asked_for(" ".join(t for t in turns or () if t)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told_by), pa.array(langs, pa.int32()), pa.array(asked, pa.int32())], ["case_key", "told", "lang", "asked"])

    return cases.select(F.col("case_key").cast("bigint").alias("case_key"), "turns").mapInArrow(scan, "case_key bigint, told string, lang int, asked int")


DIGIT = re.compile(r"\d")
MIXED = re.compile(r"[^\W_]\d|\d[^\W_]")  # digits that are no word by themselves, for which a key has 0
CONTENT = 4  # a word of the case has as many letters, and is no function word


def common_words(facts: DataFrame, often: float = 0.03) -> frozenset[str]:
    """Words of more than `often` of the cases, and of 20 at least: they say nothing of a case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for told in batch.column(0).to_pylist():
                n.update(set(told.split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    n = facts.select("told").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in n.filter(F.col("n") >= max(20, often * facts.count())).collect())  # no more than words of a case / `often`


@dataclass(slots=True)
class Told:
    """The turns of a case: their text, their words, and those that say something of the case."""

    text: str
    words: frozenset[str]
    telling: frozenset[str]


@dataclass(slots=True)
class Clause:
    """What a clause is by itself: its words, their key and their languages' counts, its marks, whether it speaks of what a
    refusal speaks of, has a digit or a colon."""

    tokens: list[str]
    key: str
    counts: int
    marks: int
    speaks: int
    digit: bool
    colon: bool


ECHO_MARK, ECHO_SHORT, BEFORE_ECHO, OF_CASE, CUT, TALK_MARK, REFUSES = (MARK[x] for x in ("echo", "echo_short", "before_echo", "of_case", "cut", "talk", "refuses"))


@dataclass
class Describer:
    """What clauses are described by: the classifier of endings and the words that many cases have."""

    endings: Endings
    common: frozenset[str] = frozenset()
    known: dict[bytes, Clause] = dataclass_field(default_factory=dict)
    cases: dict[str, Told] = dataclass_field(default_factory=dict)

    def clause(self, part: str) -> Clause:
        """Short clauses are kept, as many recur, if only with other numbers."""
        shape = shape_of(part)
        got = self.known.get(shape)
        if got is not None:
            return Clause(words(part), got.key, got.counts, got.marks, got.speaks, True, got.colon) if got.digit else got
        tokens = words(part)
        counts, bits = told_by(tokens)
        said = denied_in(part, bits)
        end, n = part.rstrip()[-1:], len(tokens)
        marks = spoken_marks(said) | (MARK["question"] if end == "?" else MARK["colon"] if end == ":" else 0)
        marks |= (MARK["quoted"] if part[:1] in ">“\"«" else 0) | (MARK["short"] if n <= 3 else MARK["long"] if n > 12 else 0)
        digit = DIGIT.search(part) is not None
        got = Clause(tokens, key_of(tokens), counts, marks, said & (DENIAL_BIT | TALK_BIT | ROLE_BIT | WILL_BIT), digit, ":" in part)
        if len(part) <= 100 and not (digit and MIXED.search(got.key)):
            if len(self.known) >= 1 << 14:
                self.known.clear()
            self.known[shape] = got
        return got

    def case(self, told: str) -> Told:
        """The answers to a case mostly follow one another."""
        got = self.cases.get(told)
        if got is None:
            if len(self.cases) >= 64:
                self.cases.clear()
            said = frozenset(told.split())
            self.cases[told] = got = Told(told, said, frozenset(t for t in said if len(t) >= CONTENT and t not in LANGUAGE_CODES and t not in self.common))
        return got

    def describe(self, text: str, told: str, lang: int, asked: int, at_limit: bool) -> tuple[list[int], list[str]]:
        """The marks and the key of each clause."""
        case = self.case(told)
        parts = clauses(text)
        looked = [self.clause(c) for c in parts]
        if not all([x.tokens for x in looked]) or not parts:
            held = [k for k, x in enumerate(looked) if x.tokens] or [0]
            parts, looked = [parts[k] for k in held], [looked[k] for k in held]
        say = MARK["bias"] | MARK[spoken(sum([x.counts for x in looked]), min(5, sum([len(x.tokens) for x in looked])), lang, asked)]
        state = self.endings.state(text)
        cut = state == INCOMPLETE or (state == ITEM and at_limit)
        said = [echoed(part, x, case) for part, x in zip(parts, looked)]
        if cut and all(said) and (TERMINAL.search(parts[-1].rstrip()) or f"{normal(looked[-1].tokens[-4:])}|" in f"{told}|"):
            cut = False  # a copied turn, which ended there
        n, out, telling = len(parts), [], case.telling
        of_case = [not telling.isdisjoint(x.tokens) for x in looked]
        for k, x in enumerate(looked):
            f = say | x.marks
            if said[k]:
                f |= ECHO_MARK if len(x.tokens) >= 4 else ECHO_SHORT
            if f & MARK["colon"] and k + 1 < n and said[k + 1]:
                f |= BEFORE_ECHO
            if of_case[k] and x.speaks:
                f |= OF_CASE
            out.append(f)
        out[0] |= MARK["first"]
        out[-1] |= MARK["last"] | (MARK["only"] if n == 1 else 0) | (CUT if cut else 0)
        seeded = any([f & REFUSES and not f & ECHO_MARK for f in out])
        for k, f in enumerate(out):
            if not f & TALK_MARK and (f & (ECHO_MARK | CUT) or looked[k].digit or of_case[k]):
                out[k] |= TOPIC
                if not seeded:
                    break  # one will do
        return out, [x.key for x in looked]


@cache
def spoken_marks(said: int) -> int:
    out = sum(MARK[k] for i, k in enumerate(KINDS) if said >> i & 1)
    out += sum(MARK[name] for bit, name in ((NO_TALK, "no_talk"), (NO_WILL, "no_will"), (DENIED, "denied")) if said & bit)
    if said >> KINDS.index("role") & said >> KINDS.index("talk") & 1:
        out += MARK["role_talk"]
    return out + (MARK["refuses"] if refuses(said) else 0)


def echoed(part: str, clause: Clause, case: Told) -> bool:
    """The turns contain the clause word for word, or what follows a lead-in and a colon."""
    tokens, told = clause.tokens, case.text
    if not tokens:
        return False
    if case.words.issuperset(tokens[:4]) and normal(tokens[:4]) in told:  # most clauses fail here already
        if len(tokens) <= 4 or normal(tokens) in told:
            return True
        if len(tokens) >= 8 and normal(tokens) in told.replace(" | ", " "):
            return True  # turns run together
    if not clause.colon:
        return False
    rest = words(part.partition(":")[2])
    lead = len(tokens) - len(rest)
    return (len(rest) >= 4 and lead <= 6 or len(rest) >= 2 and lead <= 3) and normal(rest) in told


def key_of(tokens: list[str]) -> str:
    key = " ".join(tokens)
    return key if key.replace(" ", "a").isalpha() else " ".join(["0" if t.isdigit() else t for t in tokens])


#: Answers that are taken together in a task.
BLOCK = 1 << 14


@dataclass
class Rows:
    """Answers as they are described: the clauses of one after the other."""

    marks: np.ndarray
    key: np.ndarray  # of each clause, a place in `names`
    names: list[str]
    lengths: np.ndarray  # in clauses, at least 1

    @staticmethod
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Rows]]:
        """As many as BLOCK answers at a time; the last columns of the batches are marks and keys, which aren't empty."""
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= BLOCK):
                own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held.clear()
                marks, keys = own.column(own.num_columns - 2), own.column(own.num_columns - 1).flatten().dictionary_encode()
                yield own, Rows(marks.flatten().to_numpy(), keys.indices.to_numpy(), keys.dictionary.to_pylist(), marks.value_lengths().to_numpy().astype(np.int64))

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def has(self, *names: str) -> np.ndarray:
        return self.marks & sum(MARK[n] for n in names) != 0

    @property
    def seeds(self) -> np.ndarray:
        """Clauses that are refusals by what they speak of."""
        return self.has("refuses") & ~self.has("echo")

    def any(self, clauses: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(clauses, self.first)

    def among(self, known: frozenset[str]) -> np.ndarray:
        return np.array([n in known for n in self.names], bool)[self.key]

    def labels(self, known: frozenset[str]) -> np.ndarray:
        """Tags by rule, for fitting."""
        every = lambda x: np.repeat(x, self.lengths)
        told, seeds, topical = self.among(known), self.seeds, self.marks & TOPIC != 0
        refused = self.any(seeds) | (self.any(told) & ~self.any(topical))
        echoes = self.has("echo", "echo_short")
        all_echo = ~self.any(~(echoes | self.has("colon")))
        ends = echoes[self.first + self.lengths - 1]
        out = np.where(self.has("other_language"), FOREIGN, ANSWER)
        out[every(refused) & (seeds | told | ~topical)] = REFUSAL_TAG
        out[self.has("echo") | (self.has("echo_short") & every(all_echo)) | (self.has("before_echo") & every(ends))] = ECHO  # with lead-ins
        out[self.has("cut")] = UNFINISHED
        return out


def refusals(described: DataFrame, least: int = 3, share: float = 0.02, rounds: int = 3) -> frozenset[str]:
    """Keys of clauses that belong to refusals. Words name only some; the rest is learnt from what stands with what. An answer
    that says nothing of its case and has a clause known to refuse is a refusal, one that speaks of its case and has none by its
    words is not. A clause that stands in refusals and never (by `share`) in answers of the other kind is itself known from
    then on."""
    spark = described.sparkSession
    each = described.select("marks", "keys").filter("size(marks) > 0")
    topical = F.exists("marks", lambda m: m.bitwiseAND(F.lit(TOPIC)) != 0)
    seed = lambda m: (m.bitwiseAND(F.lit(MARK["refuses"])) != 0) & (m.bitwiseAND(F.lit(MARK["echo"])) == 0)
    free = materialize(each.filter(~topical), "free")

    def sums(n: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["key", "n"])

    def counted(rows: DataFrame, chosen) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, r in Rows.blocks(batches):
                which = np.flatnonzero(chosen(r))
                row = np.repeat(np.arange(len(r.lengths)), r.lengths)[which]
                once = np.unique(row * len(r.names) + r.key[which]) % len(r.names)  # a key once an answer
                n = np.bincount(once, minlength=len(r.names))
                yield sums(Counter({r.names[k]: int(n[k]) for k in np.flatnonzero(n)}))

        return rows.mapInArrow(count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))

    recur = counted(free, lambda r: ~r.seeds).filter((F.col("n") >= least) & (F.col("key") != ""))
    asked = spark.sparkContext.broadcast(frozenset(r.key for r in recur.collect()))  # none else can be known
    good = {r.key: r.n for r in counted(each.filter(topical & ~F.exists("marks", seed)), lambda r: r.among(asked.value)).collect()} if asked.value else {}
    known: frozenset[str] = frozenset()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(known)
        bad = counted(free, lambda r: ~r.seeds & np.repeat(r.any(r.seeds | r.among(sent.value)), r.lengths) & r.among(asked.value))
        more = {r.key for r in bad.filter(F.col("n") >= least).collect() if good.get(r.key, 0) <= share * r.n}
        if more <= known:
            break
        known |= more
    return known


@dataclass
class Said:
    """The words and word pairs of keys, each known by a place in `words` or `pairs`."""

    words: list[str]
    pairs: list[str]
    word: np.ndarray  # of each word of the keys
    name: np.ndarray  # whose it is
    paired: np.ndarray  # those that others of the same key follow
    pair: np.ndarray  # of these

    @staticmethod
    def of(names: list[str]) -> Said:
        lists = pc.split_pattern(pa.array(names, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        name = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy())
        paired = np.flatnonzero(name[1:] == name[:-1])
        two = pa.array(word[paired] * len(words) + word[paired + 1]).dictionary_encode()
        pairs = [f"{words[x // len(words)]} {words[x % len(words)]}" for x in two.dictionary.to_pylist()]
        return Said(words, pairs, word, name, paired, two.indices.to_numpy().astype(np.int64))

    def counts(self, *weights: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
        """The words and pairs, and how often each is said where a key counts by its weight and what it says once."""
        out: list[list[np.ndarray]] = []
        for x, name, n in ((self.word, self.name, len(self.words)), (self.pair, self.name[self.paired], len(self.pairs))):
            once = pc.unique(pa.array(name * n + x)).to_numpy()
            out.append([np.bincount(once % max(1, n), w[once // max(1, n)], n) for w in weights])
        return self.words + self.pairs, [np.concatenate(x).astype(np.int64) for x in zip(*out)]


@dataclass
class Model:
    """What decides: the numbers of words and word pairs, and the field. `without` are marks of features to leave out."""

    words: dict[str, int]
    field: crf.Chain | None = None
    without: int = 0

    def kinds(self, marks: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """The features of each kind of marks, and the kind of each clause."""
        kinds, kind = np.unique(marks & (TOPIC - 1) & ~self.without, return_inverse=True)
        return [[i for i in range(len(BASE)) if m >> i & 1] or [0] for m in kinds.tolist()], kind

    def ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each key's words and word pairs, one after the other, and where each key's begin."""
        said, get = Said.of(names), self.words.get
        numbers = np.zeros((len(said.word), 2), np.int32)
        numbers[:, 0] = np.array([get(x, 0) for x in said.words], np.int32)[said.word]
        numbers[said.paired, 1] = np.array([get(x, 0) for x in said.pairs], np.int32)[said.pair]
        n = np.bincount(said.name, (numbers > 0).sum(axis=1), len(names)).astype(np.int64)
        return numbers[numbers > 0], np.concatenate([[0], np.cumsum(n)])

    def tags(self, r: Rows) -> np.ndarray:
        kinds, kind = self.kinds(r.marks)
        emit = np.ascontiguousarray(self.field.emit.T)
        scores = crf.sums(emit, *flat(kinds)).take(kind, axis=1) + crf.sums(emit, *self.ids(r.names)).take(r.key, axis=1)
        return self.field.tags(np.ascontiguousarray(scores.T), r.lengths)


def vocabulary(each: DataFrame, known: frozenset[str], n_rows: int, most: int, plain: tuple[int, float], rarely: int, least: int) -> tuple[dict[str, int], float, float]:
    """Numbers of words and word pairs, the weight of an answer whose tags are all `answer`, and the weight of all answers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, r in Rows.blocks(batches):
            tags = r.labels(known)
            weight = np.where(r.any(tags == REFUSAL_TAG), rarely, r.any(tags != ANSWER).astype(int))
            said, (marked, rest) = Said.of(r.names).counts(*(np.bincount(r.key, np.repeat(w, r.lengths), len(r.names)) for w in (weight, weight == 0)))
            named = pa.array(said, pa.string())
            counts = pa.RecordBatch.from_arrays([named, pa.array(marked), pa.array(rest)], ["word", "marked", "rest"])
            yield counts.filter(pc.not_equal(named, ""))  # a key without words
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([int(weight.sum())]), pa.array([int((weight == 0).sum())])], ["word", "marked", "rest"])

    counted = materialize(each.mapInArrow(count, "word string, marked bigint, rest bigint").groupBy("word").agg(F.sum("marked").alias("marked"), F.sum("rest").alias("rest")), "words")
    total = counted.filter("word is null").first()
    share = min(1.0, max(plain[0], plain[1] * n_rows) / max(1, total.rest))
    n = F.col("marked") + F.lit(share) * F.col("rest")
    kept = counted.filter("word is not null").withColumn("n", n).filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    return {r.word: len(BASE) + i for i, r in enumerate(kept)}, share, total.marked + share * total.rest


def fit(described: DataFrame, least: int = 3, most: int = 30_000, plain: tuple[int, float] = (3_000, 0.15), rarely: int = 4, without: tuple[str, ...] = ()) -> Model:
    """The model from all described answers. Answers that some rule tags as other than answer count once, those with refusals
    `rarely` times, as they are few and worded in many ways; the others count less, as if they were `plain` answers, a number
    or a share of all, in sum. Of words and pairs the `most` frequent, by these weights, have numbers."""
    spark = described.sparkSession
    each = described.select("marks", "keys").filter("size(marks) > 0")
    n_rows = each.count()
    if not n_rows:
        return Model({})
    known = refusals(described)
    numbers, share, weight = vocabulary(each, known, n_rows, most, plain, rarely, least)
    model = Model(numbers, None, sum(MARK[x] for x in without))
    sent = spark.sparkContext.broadcast((model, known))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for _, r in Rows.blocks(batches):
            tags = r.labels(known)
            weights = np.where(r.any(tags == REFUSAL_TAG), rarely, np.where(r.any(tags != ANSWER), 1.0, share))
            kinds, kind = model.kinds(r.marks)
            block = crf.Block.of(kinds, model.ids(r.names), kind, r.key, r.lengths, tags, weights)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    blocks = materialize(each.mapInArrow(label, "block binary"), "blocks")
    near = [pickle.loads(r.block) for r in blocks.collect()] if n_rows <= BLOCK else None  # few answers are fitted here
    shape = len(BASE) + len(numbers), len(TAGS)

    def gradient(w: crf.Chain) -> tuple[float, crf.Chain]:
        if near is not None:
            return added(b.gradient(w) for b in near)
        now = spark.sparkContext.broadcast(w)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, g = added(pickle.loads(x.as_py()).gradient(now.value) for batch in batches for x in batch.column(0))
            if g is not None:
                yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([pickle.dumps((g.emit.astype(np.float32), g.move, g.start))], pa.binary())], ["value", "g"])

        out = added((r.value, crf.Chain(*pickle.loads(r.g))) for r in blocks.mapInArrow(add, "value double, g binary").collect())
        now.destroy()
        return out

    decay = np.full(shape[0], 3e-3)  # words explain what the other features leave open
    decay[: len(BASE)] = 1e-3
    decay[[B[x] for x in DIRECT]] = 1e-6
    model.field = crf.climb(gradient, weight, *shape, decay=decay)
    return model


def added(parts: Iterator[tuple[float, crf.Chain]]) -> tuple[float, crf.Chain | None]:
    value, out = 0.0, None
    for v, g in parts:
        value += v
        if out is None:
            out = crf.Chain(g.emit.astype(np.float64), g.move, g.start)
        else:
            out.emit += g.emit
            out.move += g.move
            out.start += g.start
    return value, out


def decide(tags: list[int], sizes: list[int], copied: float, refused: float, foreign: float) -> str | None:
    """One defect from the tags of a response's clauses and their numbers of words."""
    n = sum(sizes) or 1
    cover = [0] * len(TAGS)
    for t, s in zip(tags, sizes):
        cover[t] += s
    if tags[-1] == ECHO and cover[ECHO] >= copied * n:  # else an answer follows the quotation
        return "copy"
    if cover[REFUSAL_TAG] >= refused * n:
        return "refusal"
    if cover[FOREIGN] >= foreign * n:
        return "language"
    return "truncated" if tags[-1] == UNFINISHED else None


def described(results: DataFrame, cases: DataFrame, found: DataFrame) -> DataFrame:
    """Every answer of every delivery: result_id, received_at, model_name, text_hash, and the marks and keys of its clauses, none
    if it says nothing. The texts move once, to their case."""
    facts = materialize(case_facts(cases), "facts")
    sent = results.sparkSession.sparkContext.broadcast(Describer(fit_endings(results), common_words(facts)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = sent.value
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):  # few live lists at a time
            marks: list[list[int]] = []
            keys: list[list[str]] = []
            for text, told, lang, asked, limit in zip(*(batch.column(k).to_pylist() for k in range(4, 9))):
                m, k = ([], []) if says_nothing(text) else d.describe(text, told or "", -1 if lang is None else lang, asked or 0, limit)
                marks.append(m)
                keys.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(marks, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.string()))], ["result_id", "received_at", "model_name", "text_hash", "marks", "keys"])

    pairs = mark_limits(answers(results, "case_key").join(facts, "case_key", "left"), found).withColumn("text_hash", F.xxhash64("response"))
    told = pairs.select("result_id", "received_at", "model_name", "text_hash", "response", "told", "lang", "asked", "at_limit")
    return materialize(told.mapInArrow(describe, "result_id bigint, received_at timestamp_ntz, model_name string, text_hash bigint, marks array<int>, keys array<string>"), "described")


def defects(results: DataFrame, cases: DataFrame, copied: float = 0.85, refused: float = 0.6, foreign: float = 0.6, without: tuple[str, ...] = ()) -> DataFrame:
    """result_id, model_name, defect of every defective answer; `without` names features (BASE) to do without."""
    again = deliveries(results)
    each = described(results, cases, limits(results, again))
    sent = results.sparkSession.sparkContext.broadcast(fit(each, without=without))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, r in Rows.blocks(batches):
            tags, first = sent.value.tags(r), r.first
            sizes = np.array([n.count(" ") + 1 if n else 0 for n in r.names])[r.key]
            out: list[str | None] = [None] * len(r.lengths)
            for i in np.flatnonzero(r.any(tags != ANSWER)).tolist():
                own_clauses = slice(first[i], first[i] + r.lengths[i])
                out[i] = decide(tags[own_clauses].tolist(), sizes[own_clauses].tolist(), copied, refused, foreign)
            kept = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*own.columns[:4], kept], ["result_id", "received_at", "model_name", "text_hash", "defect"]).filter(kept.is_valid())

    says = F.size("marks") > 0
    bad = each.filter(says).mapInArrow(judge, "result_id bigint, received_at timestamp_ntz, model_name string, text_hash bigint, defect string")
    empty = each.filter(~says).select(*bad.columns[:4], F.lit("empty").alias("defect"))
    return first_only(materialize(bad.union(empty), "defects"), again).select("result_id", "model_name", "defect").distinct()


RESULTS = "result_id bigint, case_key bigint, received_at timestamp_ntz, responses map<string, struct<response: string>>"
