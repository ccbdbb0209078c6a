"""Stemmers of English, French and German, after their published Snowball descriptions, and the rule that tells a language by them.

A stemmer gives (stem, recognised): recognised where one of its suffixes applied or the word is a common one. Suffix tables are tried longest
first. R1 is what follows the first consonant after a vowel, R2 the same within R1. Words are lower case.

Of the English additions that the wider engine family has (prefixes, superlatives, repairs of a lost e) none is made: stems
are those of the published algorithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words that count as recognised.
COMMON = {
    "en": frozenset("the be to of and in that you have with from but".split()),
    "fr": frozenset("les des une est que dans qui pas pour sur".split()),
    "de": frozenset("der die das und sie ich mit sich auf nicht".split()),
}


def region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first consonant that follows a vowel begins, from start on; else the word's length."""
    for k in range(start + 1, len(word)):
        if word[k] not in vowels and word[k - 1] in vowels:
            return k + 1
    return len(word)


def longest(word: str, suffixes: tuple[str, ...]) -> str:
    """The longest of some suffixes that a word ends in, or an empty text."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


EN_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
EN_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
EN_STEP4 = tuple("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split())


def english(word: str) -> tuple[str, bool]:
    v = "aeiouy"
    if len(word) < 3:
        return word, word in COMMON["en"]
    w = word.lstrip("'")
    if w in EN_SPECIAL:
        return EN_SPECIAL[w], True
    w = "".join("Y" if c == "y" and (k == 0 or w[k - 1] in v) else c for k, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or region(w, v)
    r2 = region(w, v, r1)

    def short_end(x: str) -> bool:
        return (len(x) == 2 and x[0] in v and x[1] not in v) or (len(x) > 2 and x[-3] not in v and x[-2] in v and x[-1] not in v + "wxY")

    before = w
    w = w.removesuffix(longest(w, ("'", "'s", "'s'")))
    s = longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in v for c in w[:-2]):
        w = w[:-1]
    if w in EN_KEPT:
        return w, True
    s = longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
    elif s and any(c in v for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in v:
        w = w[:-1] + "i"
    s = longest(w, (*EN_STEP2, "ogi", "li"))
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(s)] + EN_STEP2[s]
    s = longest(w, (*EN_STEP3, "ative"))
    if s == "ative":
        w = w[:-5] if len(w) - 5 >= r2 else w
    elif s and len(w) - len(s) >= r1:
        w = w[: -len(s)] + EN_STEP3[s]
    s = longest(w, (*EN_STEP4, "ion"))
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    w = w.replace("Y", "y")
    return w, w != before.replace("Y", "y") or word in COMMON["en"]


def german(word: str) -> tuple[str, bool]:
    v = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < k < len(w) - 1 and w[k - 1] in v and w[k + 1] in v else c for k, c in enumerate(w))
    r1 = region(w, v)
    r2, r1 = region(w, v, r1), max(3, r1)
    before = w
    s = longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if s and len(w) - len(s) >= r1 and (s != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(s)]
        if s in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    s = longest(w, ("en", "er", "est", "st"))
    if s and len(w) - len(s) >= r1 and (s != "st" or (len(w) > 5 and w[-3] in "bdfghklmnt")):
        w = w[: -len(s)]
    s = longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if s and len(w) - len(s) >= r2 and not (s in ("ig", "ik", "isch") and w[: -len(s)].endswith("e")):
        w = w[: -len(s)]
        more = {"end": ("ig",), "ung": ("ig",), "lich": ("er", "en"), "heit": ("er", "en"), "keit": ("lich", "ig")}.get(s, ())
        t = longest(w, more)
        if t and len(w) - len(t) >= (r1 if s in ("lich", "heit") else r2) and not (t == "ig" and s != "keit" and w[:-2].endswith("e")):
            w = w[: -len(t)]
    changed = w != before
    return w.lower().translate({ord("ä"): "a", ord("ö"): "o", ord("ü"): "u"}), changed or word in COMMON["de"]


FR_VERB_I = tuple("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
FR_VERB_R = tuple("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split())
FR_VERB_A = tuple("âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split())
FR_PLAIN = tuple(f"{s}{p}" for s in ("ance", "iqUe", "isme", "able", "iste", "eux") for p in ("", "s") if s + p != "euxs")
FR_AT = tuple(f"{s}{p}" for s in ("atrice", "ateur", "ation") for p in ("", "s"))
FR_TURNED = {"logie": "log", "logies": "log", "usion": "u", "usions": "u", "ution": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_FIRST = (*FR_PLAIN, *FR_AT, *FR_TURNED, "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments")


def french(word: str) -> tuple[str, bool]:
    v = "aeiouyâàëéêèïîôûù"
    at = lambda k: word[k] if 0 <= k < len(word) else " "
    mark = lambda k, c: (c == "u" and at(k - 1) == "q") or (c in "ui" and at(k - 1) in v and at(k + 1) in v) or (c == "y" and (at(k - 1) in v or at(k + 1) in v))
    w = "".join(c.upper() if mark(k, c) else c for k, c in enumerate(word))
    r1 = region(w, v)
    r2 = region(w, v, r1)
    if w[:3] in ("par", "col", "tap") or (len(w) > 2 and w[0] in v and w[1] in v):
        rv = 3
    else:
        rv = next((k + 1 for k in range(1, len(w)) if w[k] in v), len(w))
    before, verbs = w, False

    def drop(x: str, s: str, r: int, other: str | None = None) -> str:
        """x without s if s is in the region; else with another ending, if there is one."""
        if not x.endswith(s):
            return x
        return x[: -len(s)] if len(x) - len(s) >= r else x if other is None else x[: -len(s)] + other

    s = longest(w, FR_FIRST)
    n = len(w) - len(s)
    if s in FR_PLAIN:
        w = w[:n] if n >= r2 else w
    elif s in FR_AT:
        w = drop(w[:n], "ic", r2, "iqU") if n >= r2 else w
    elif s in FR_TURNED:
        w = w[:n] + FR_TURNED[s] if n >= r2 else w
    elif s in ("ement", "ements") and n >= rv:
        w = w[:n]
        if w.endswith("iv"):
            w = drop(w, "iv", r2)
            w = drop(w, "at", r2)
        elif w.endswith("eus"):
            w = w[:-3] if len(w) - 3 >= r2 else w[:-3] + "eux" if len(w) - 3 >= r1 else w
        elif w.endswith(("abl", "iqU")):
            w = w[:-3] if len(w) - 3 >= r2 else w
        elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif s in ("ité", "ités") and n >= r2:
        w = w[:n]
        w = drop(w, "abil", r2, "abl") if w.endswith("abil") else drop(w, "ic", r2, "iqU") if w.endswith("ic") else drop(w, "iv", r2)
    elif s in ("if", "ive", "ifs", "ives") and n >= r2:
        w = w[:n]
        if w.endswith("at") and len(w) - 2 >= r2:
            w = drop(w[:-2], "ic", r2, "iqU")
    elif s == "eaux":
        w = w[:-1]
    elif s == "aux" and n >= r1:
        w = w[:n] + "al"
    elif s in ("euse", "euses"):
        w = w[:n] if n >= r2 else w[:n] + "eux" if n >= r1 else w
    elif s in ("issement", "issements") and n >= r1 and w[n - 1 : n] not in tuple(v):
        w = w[:n]
    elif s in ("amment", "emment") and n >= rv:
        w, verbs = w[:n] + s[0] + "nt", True
    elif s in ("ment", "ments") and n - 1 >= rv and w[n - 1] in v:
        w, verbs = w[:n], True
    if w == before or verbs:
        s = longest(w[rv:], FR_VERB_I)
        first = w
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in v:
            w = w[: -len(s)]
        else:
            s = longest(w[rv:], (*FR_VERB_R, *FR_VERB_A, "ions"))
            if s == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif s in FR_VERB_R:
                w = w[: -len(s)]
            elif s:
                w = w[: -len(s)]
                w = w[:-1] if w.endswith("e") and len(w) - 1 >= rv else w
        verbs = w == first
    else:
        verbs = False
    if w != before and not verbs:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        s = longest(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv else w
        elif s in ("ier", "ière", "Ier", "Ière"):
            w = w[: -len(s)] + "i"
        elif s == "e":
            w = w[:-1]
        elif s and w.endswith("guë"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    k = len(w)
    while k and w[k - 1] not in v:
        k -= 1
    if 0 < k < len(w) and w[k - 1] in "éè":
        w = w[: k - 1] + "e" + w[k:]
    return w.lower(), w.lower() != word or word in COMMON["fr"]


STEMMERS = {"en": english, "fr": french, "de": german}
#: Fixed values of the language rule: words looked back on, and how many of them a language must know.
LOOK_BACK, ENOUGH = 64, 4


def stemmed(word: Column, lang: str) -> Column:
    """struct(stem, recognised). Words are best counted first, so that each is stemmed once."""
    stem = STEMMERS[lang]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            found = [stem(w) if w is not None else (None, None) for w in words.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([r for _, r in found], pa.bool_())], names=["stem", "recognised"])

    return F.arrow_udf(run, "struct<stem:string,recognised:boolean>")(word)


def languages(words: list[str], known: dict[str, dict[str, bool]] | None = None) -> list[str | None]:
    """The language after each word: that of most recognised words among the last LOOK_BACK, ENOUGH at least.

    Of equals the first of en, fr, de wins, but the language so far has one word's advantage over those before it in that order.
    """
    known = known if known is not None else {k: {} for k in STEMMERS}
    names = list(STEMMERS)[::-1]
    recent = {k: [] for k in names}
    count = dict.fromkeys(names, 0)
    out: list[str | None] = []
    now: str | None = None
    for i, w in enumerate(words):
        for k in names:
            if w not in known[k]:
                known[k][w] = STEMMERS[k](w)[1]
            recent[k].append(known[k][w])
            count[k] += known[k][w] - (recent[k][i - LOOK_BACK] if i >= LOOK_BACK else 0)
        least, found = ENOUGH, None
        for k in names:
            if count[k] >= least:
                least, found = count[k] + (k == now), k
        now = found
        out.append(now)
    return out


def told(hits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """languages() of many texts at once: for each word the number of its language in the order de, fr, en, 3 for none.

    hits: by language and word, whether it is recognised; first: the place of each word's text's first word. What a word makes of the
    language so far is a function of four values; the same for all of them at most words, and composed by doubling over the others.
    """
    size = hits.shape[1]
    total = np.zeros((len(hits), size + 1), np.int64)
    np.cumsum(hits, axis=1, out=total[:, 1:])
    at = np.arange(size)
    count = total[:, 1:] - total[:, np.maximum(first, at - LOOK_BACK + 1)]
    after = np.empty((4, size), np.uint8)
    for now in range(4):
        least, found = np.full(size, ENOUGH, np.int64), np.full(size, 3, np.uint8)
        for k in range(3):
            better = count[k] >= least
            least = np.where(better, count[k] + (k == now), least)
            found[better] = k
        after[now] = found
    after[:, first == at] = after[3, first == at]
    open_ = np.flatnonzero((after != after[0]).any(axis=0))
    step = 1
    while len(open_):
        before = after[:, open_ - step]
        after[:, open_] = np.take_along_axis(after[:, open_], before, axis=0)
        open_ = open_[(before != before[0]).any(axis=0)]
        step *= 2
    return after[0]


#: What the stemmers say of so many words, kept by a worker process: a bit for each of de, fr, en.
KEPT_WORDS = 400_000
_KNOWN: dict[str, int] = {}


def recognised(words: list[str]) -> np.ndarray:
    """By language (de, fr, en) and word, whether its stemmer recognises it. Called by name, so what is kept outlives a task."""
    if len(_KNOWN) > KEPT_WORDS:
        _KNOWN.clear()
    out = np.empty(len(words), np.uint8)
    for i, w in enumerate(words):
        bits = _KNOWN.get(w)
        if bits is None:
            bits = _KNOWN[w] = sum(STEMMERS[k](w)[1] << j for j, k in enumerate(list(STEMMERS)[::-1]))
        out[i] = bits
    return (out >> np.arange(3, dtype=np.uint8)[:, None] & 1).astype(bool)


def language_words(text: Column) -> Column:
    """map of language (en, fr, de, none) to the number of words after which it was the text's language."""
    from ..operators.counting import split_words

    names = [*list(STEMMERS)[::-1], "none"]
    listed = sorted(range(4), key=lambda k: names[k])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            word, different, at = split_words(texts)
            n = np.zeros((len(texts), 4), np.int64)
            if len(word):
                begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                first = np.repeat(begin, np.diff(np.append(begin, len(at))))
                n = np.bincount(at * 4 + told(recognised(different.to_pylist())[:, word], first), minlength=4 * len(texts)).reshape(-1, 4)
            yield pa.array([[(names[k], row[k]) for k in listed if row[k]] for row in n.tolist()], pa.map_(pa.string(), pa.int64()))

    return F.arrow_udf(run, "map<string,bigint>")(text)
