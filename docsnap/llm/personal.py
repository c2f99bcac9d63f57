"""Personal data in texts, by anchors and local parsers.

One pass of an Aho-Corasick automaton over a text finds the anchors: at-signs, plus signs, digits,
schemes and cues such as ``IBAN`` or ``passport``. From each anchor a parser reads what stands
next to it and checks it, so a text without anchors costs one pass and nothing is read twice
but around anchors. Base kinds:

- email: local part, at-sign, labels with dots between them;
- ip: four numbers of at most 255;
- card: 12 to 19 digits, single blanks or hyphens between them, that pass the Luhn check;
- phone: a plus sign, then 9 to 15 digits with the usual marks.

Each takes the leftmost matches that do not overlap within its kind; a match that fails its check is
dropped, and reading goes on behind it. Added kinds: ``url`` (from a scheme to the last character that can
end an address), ``iban`` (behind its cue, check digits right) and ``account`` (six or more
letters and digits, one digit at least, behind a cue). They are found beside the base kinds and
change nothing there.

Spans count code points, their end is exclusive. Null and empty texts have none. Rows that repeat
an id, null ids and extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docsnap.llm.common import parts, remembered

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
URL = r"[^\s<>\"'`{}|\\^\[\]]*[A-Za-z0-9/_~#=&%+-]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCOUNT = r"[\s:#.]{1,4}(?:(?:no|nr|number|id|is)\b[\s:#.]{0,4})?([A-Za-z0-9-]{6,34})(?![A-Za-z0-9-])"
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("account", "acct", "passport", "ssn", "user id", "customer id", "license no", "tax id")


def anchors():
    """The automaton: each anchor gives its kind and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for words, kind in ((SCHEMES, "url"), (("iban",), "iban"), (CUES, "account")):
        for word in words:
            for form in {word, word.upper(), word.title(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    total += sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def iban_right(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Parsers:
    """Expands anchors to spans; built once in each worker."""

    def __init__(self) -> None:
        self.automaton = anchors()
        self.domain, self.ip, self.card, self.phone, self.url, self.iban, self.account = (
            re.compile(p).match for p in (DOMAIN, IP, CARD, PHONE, URL, IBAN, ACCOUNT)
        )

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans by start, then kind in the order of ``KINDS``."""
        found: list[tuple[str, int, int]] = []
        done = dict.fromkeys(KINDS, 0)  # where the last match of the kind ended, right or not
        previous = -2
        for last, (kind, length) in self.automaton.iter(text):
            at = last - length + 1
            if kind == "digit":
                # Within a run of digits only its first, or the first behind a match, can begin one.
                follows = previous == at - 1
                previous = at
                if at >= done["ip"] and (not follows or at == done["ip"]) and (match := self.ip(text, at)):
                    done["ip"] = match.end()
                    if all(len(n.lstrip("0")) <= 3 and int(n) <= 255 for n in match[0].split(".")):
                        found.append(("ip", at, match.end()))
                if at >= done["card"] and (match := self.card(text, at)):
                    done["card"] = match.end()
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, match.end()))
            elif at < done[kind]:
                continue
            elif kind == "email":
                start = at
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (match := self.domain(text, at + 1)):
                    done["email"] = match.end()
                    found.append(("email", start, match.end()))
            elif kind == "phone":
                if match := self.phone(text, at):
                    done["phone"] = match.end()
                    if 9 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
                        found.append(("phone", at, match.end()))
            elif kind == "url":
                if (at == 0 or not text[at - 1].isalnum()) and (match := self.url(text, last + 1)):
                    done["url"] = match.end()
                    found.append(("url", at, match.end()))
            elif at and text[at - 1].isalnum():
                continue  # the cue is the end of a longer word
            elif kind == "iban":
                start = last + 1
                while start < len(text) and start < last + 6 and text[start] in " :#.\n":
                    start += 1
                if (match := self.iban(text, start)) and iban_right(match[0]):
                    done["iban"] = match.end()
                    found.append(("iban", start, match.end()))
            elif match := self.account(text, last + 1):
                if any("0" <= c <= "9" for c in match[1]):
                    done["account"] = match.end()
                    found.append(("account", match.start(1), match.end()))
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return found


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base_sha256`` of their spans, and all ``spans``."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = remembered("parsers", 0, Parsers)
        for batch in parts(batches):
            counts, digests, texts = [], [], []
            for text in batch["text"]:
                spans = parsers.spans(text.as_py() or "")
                base = [s for s in spans if s[0] in BASE]
                counts.append([sum(s[0] == kind for s in base) for kind in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(spans))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *columns, pa.array(digests), pa.array(texts)],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kinds = ", ".join(f"n_{k} long" for k in BASE)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(find, schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
