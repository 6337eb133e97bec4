"""Content and link features of the page-like part of a commit, in two views that share nothing.

The page-like part is the body of the message and the added lines of files that aren't code, configuration or data.

* The form of its lines, from which weak labels are made: each line is told by its form only, never by topic words, as a
  sentence, a line of links, a line with a price or an article number, a line of bare keywords, or code.
* Its texture, which the trees see: shares of kinds of characters, lengths, variety and repetition of words, how well it
  compresses. No line is told apart here, and no rule of the labels can be read from it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import pairwise
from math import sqrt

# Frequent function words of the languages that the messages are written in.
FUNCTION_WORDS = frozenset(
    """
    the a an of to in on for and or is was were be been are it its this that these those with from by as at not but if when which who because so than then
    there their they them we our you your i he she his her has have had do does did can could will would should may must only also into after before under over
    der die das ein eine einen dem den des und oder ist war sind wird werden nicht mit von zu zum zur im in auf für bei aus als wenn weil dass sich es er sie wir
    nur noch auch nach vor
    el la los las un una unos unas de del y o es son fue era no con por para en al que se su sus lo como cuando si porque más pero este esta esto sin
    le les des du et ou est sont était ne avec par pour dans sur au aux que qui ce cette ces il elle nous vous plus mais quand sans
    os as um uma do da dos das e ou é são foi não com por para em no na nos nas ao que se seu sua mais mas quando porque este esta isto sem
    """.split()
)
# Endings and names of files that hold code, configuration, data or records of releases.
OTHER_ENDINGS = frozenset(
    """
    py go ts tsx js jsx java kt scala rs c h cc cpp hpp cs rb php swift pl lua r sh bash ps1 sql tf hcl json jsonl yaml yml toml ini cfg conf env lock sum mod
    xml csv tsv log po properties proto gradle bat css scss map png gif jpg jpeg svg ico woff woff2 ttf zip gz tar bin pt parquet pdf netrc patch
    """.split()
)
OTHER_NAMES = re.compile(r"(?i)(^|/)(requirements[^/]*\.txt|changelog[^/]*|changes[^/]*|release[-_ ]?notes[^/]*|history\.md|news(\.md)?|makefile|dockerfile|go\.sum|license[^/]*|\.[^/]+)$|(^|/)(i18n|locales?|fixtures?|third_party|vendor|node_modules)/")

_DIFF = re.compile(r"^diff --(?:git|cc|combined) ", re.M)
_URL = re.compile(r"https?://([^/\s\"'<>)\]]+)[^\s\"'<>)\]]*")
_TAG = re.compile(r"<[^<>\n]+>")
_WORD = re.compile(r"[^\W\d_]+")
_PRICE = re.compile(r"(?:[$€£¥]\s?\d)|\b\d+[.,]\d{2}\b|\b\d+\s?(?:EUR|USD|GBP|%)|\bSKU\b|\b(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{5,}\b")
_HASH = re.compile(r"(?:^|(?<=\s))[#@][^\W\d]\w*")
URL_WORDS = 3  # a URL weighs as much as so many words
_CODE = re.compile(r"[{};=]|\w\(|\)\s*$|^\s*[\w.\-\"']+\s*:\s|->|::|^\s*(?://|/\*|--\s)")
_META = re.compile(r"(?i)<meta[^>]+content=\"([^\"]*)\"")
_HEADER = re.compile(r"^(commit |author:?\s|authordate|date:|from |from:|subject:|merge:|commitdate|committer|parent |tree |[0-9a-f]{7,40}\b|---\s*$|---$)", re.I)

NAMES = (
    "words", "sentence_share", "sentences", "lines", "link_lines", "link_share", "hosts", "host_share", "bare_links", "price_lines", "price_share", "keyword_words",
    "keyword_share", "keyword_kinds", "keyword_top", "keyword_pairs", "keyword_line_words", "tags", "bullet_share", "code_share", "block", "plain_share",
)


def page_lines(text: str) -> tuple[list[str], int]:
    """The lines of the page-like part, and how many other lines were added."""
    lines, other = [], 0
    found = _DIFF.search(text)
    start = found.start() if found else -1
    head = text[:start] if found else text
    for line in head.split("\n"):
        if not _HEADER.match(line):
            lines.append(line[9:] if line.startswith("Subject: ") else line)
    if start < 0:
        return lines, other
    for part in _DIFF.split(text[start:])[1:]:
        first = part.split("\n", 1)[0]
        name = (first.rpartition(" b/")[2] if " b/" in first else first).strip()
        ending = name.rpartition("/")[2].rpartition(".")
        if (ending[1] and ending[2].lower() in OTHER_ENDINGS) or OTHER_NAMES.search(name):
            other += part.count("\n+")
        else:
            lines += [x[1:] for x in part.split("\n") if x[:1] == "+" and x[:4] != "+++ "]
    return lines, other


def features(text: str | None) -> list[float]:
    """The values of ``NAMES``; all zero for a null or empty text."""
    return line_forms(*page_lines(text or ""))


def line_forms(lines: list[str], other: int) -> list[float]:
    n = sentences = link_lines = price_lines = bullets = code = tags = bare = block = best = 0
    w_all = w_sentence = w_link = w_price = w_code = 0
    hosts: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()
    keyword_lines = 0
    for raw in lines:
        line = raw.strip()
        if not line:
            continue
        n += 1
        urls = _URL.findall(line) if "://" in line else []
        meta = _META.search(line) if "<meta" in line else None
        plain = meta[1] if meta else line
        if urls:
            plain = _URL.sub(" ", plain)
        if "<" in plain:
            plain = _TAG.sub(" ", plain)
        words = _WORD.findall(plain.lower())
        k = len(words)
        w_all += k + URL_WORDS * len(urls)
        if line[0] in "-*+•" and line[1:2] == " ":
            bullets += 1
        function = [w for w in words if w in FUNCTION_WORDS]
        kinds_of = len(set(function))
        varied = k < 8 or len(set(words)) >= 0.55 * k  # keywords repeat themselves, sentences hardly
        ends = plain.rstrip(" \"'`)*_|")[-1:] in (".", "!", "?", "。")
        if k >= 4 and varied and not meta and ((kinds_of >= 2 and len(function) >= 0.12 * k) or (ends and kinds_of and len(function) >= 0.06 * k)):
            sentences += 1
            w_sentence += k
            block = 0
            continue
        hashes = len(_HASH.findall(line)) if "#" in line or "@" in line else 0
        if urls:
            link_lines += 1
            w_link += k + URL_WORDS * len(urls)
            hosts.update(urls)
            bare += not k
        elif _CODE.search(plain) and not hashes:
            code += 1
            w_code += k
            block = 0
            continue
        elif _PRICE.search(plain):
            price_lines += 1
            w_price += k
        elif k >= 2 or hashes:
            keyword_lines += 1
            tags += hashes
            kinds.update(words)
            pairs.update(zip(words, words[1:], strict=False))
        else:
            continue
        block += k + URL_WORDS * len(urls)
        best = max(best, block)
    w_keyword = sum(kinds.values())
    total = max(1, w_all)
    return [
        w_all, w_sentence / total, sentences, n, link_lines, w_link / total, len(hosts), len(hosts) / max(1, sum(hosts.values())), bare, price_lines, w_price / total, w_keyword,
        w_keyword / total, len(kinds) / max(1, w_keyword), max(kinds.values(), default=0) / max(1, w_keyword), max(pairs.values(), default=0) / max(1, w_keyword), w_keyword / max(1, keyword_lines),
        tags, bullets / max(1, n), w_code / total, best, n / max(1, n + other),
    ]


def weak_label(f: list[float]) -> int:
    """1 spam, 0 not, -1 unsure: by rules that hold only for clear cases."""
    v = dict(zip(NAMES, f, strict=True))
    lists = v["keyword_share"] + v["link_share"] + v["price_share"]
    marked = v["link_lines"] + v["tags"] + v["price_lines"]
    if v["sentence_share"] > 0.6 or v["block"] < 15 or (not marked and (v["keyword_kinds"] > 0.75 or v["block"] < 30)):
        return 0
    if (v["sentence_share"] < 0.4 and lists > 0.6) or (v["sentences"] <= 2 and lists > 0.45):
        if v["link_lines"] >= 6 and v["hosts"] >= 5 and v["link_share"] > 0.5:
            return 1
        if v["price_lines"] >= 6 and v["price_share"] > 0.5:
            return 1
        if v["keyword_words"] >= 40 and v["keyword_kinds"] < 0.5 and v["keyword_share"] > 0.5:
            return 1
        if v["tags"] >= 8 or (v["hosts"] >= 3 and v["keyword_words"] >= 12 and v["block"] >= 30):
            return 1
    return -1


TEXTURE = (
    "characters", "lines", "mean_line", "line_spread", "letters", "digits", "capitals", "blanks", "slashes", "points", "commas", "brackets", "marks", "bars", "quotes", "angles",
    "word_length", "variety", "top_word", "top_pair", "function_share", "function_kinds", "squeeze", "ended_lines", "repeated_lines", "capital_words", "long_run", "plain_share",
)


def texture(lines: list[str], other: int) -> list[float]:
    """The values of ``TEXTURE``; all zero where there are no lines with text."""
    lines = [x for x in map(str.strip, lines) if x]
    body = "\n".join(lines)
    n = len(body)
    if not n:
        return [0.0] * len(TEXTURE)
    count = Counter(body)
    share = lambda kinds: sum(count[c] for c in kinds) / n
    spelt = _WORD.findall(body)
    words = [w.lower() for w in spelt]
    k = max(1, len(words))
    letters = sum(map(len, words))
    uses, pairs = Counter(words), Counter(pairwise(words))
    run = longest = functions = 0
    for w in words:
        known = w in FUNCTION_WORDS
        functions += known
        run = 0 if known else run + 1
        longest = max(longest, run)
    lengths = list(map(len, lines))
    mean = sum(lengths) / len(lines)
    raw = body.encode("utf-8", "replace")
    return [
        n, len(lines), mean, sqrt(sum((x - mean) ** 2 for x in lengths) / len(lines)), letters / n, share("0123456789"), sum(v for c, v in count.items() if c.isupper()) / n, share(" \t"), share("/:"),
        share("."), share(","), share("{}()[];="), share("#@"), share("|"), share("\"'`"), share("<>"), letters / k, len(uses) / k, max(uses.values(), default=0) / k, max(pairs.values(), default=0) / k,
        functions / k, len(uses.keys() & FUNCTION_WORDS), len(zlib.compress(raw, 1)) / len(raw), sum(x[-1] in ".!?。" for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        sum(w[0].isupper() for w in spelt) / k, longest, len(lines) / max(1, len(lines) + other),
    ]


def views(text: str | None) -> tuple[list[float], int, float]:
    """The texture, the weak label, and the longest run of words outside sentences."""
    page = page_lines(text or "")
    forms = line_forms(*page)
    return texture(*page), weak_label(forms), forms[NAMES.index("block")]
