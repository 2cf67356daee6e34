"""URL filter: host and path rules first, then a weighted vocabulary found by one Aho-Corasick pass.

The method looks for terms in the URL with A-Z in lower case. A hit counts only where no letter or digit stands directly
before and after it, so terms, which are single words, never lie in one another. One strict term blocks, as does one term
in the host that is strict there: a word that whole sites of a kind bear in their names but that pages on other sites may
well have in a path. So do at least ``soft_hits`` distinct soft terms, among which those count too. Where a rule fits, the
longest one (host and path characters) decides instead.

The words are common names of the trades that such filters keep out (pornography, gambling, drug sales, loans, spam and
advert tracking), not a list of hosts; word and weight are parameters.

Null URLs and URLs without ``://`` have an empty host and path and are judged by the method alone. Empty URLs are allowed,
an empty table gives no rows, repeated rows are judged alike, very long URLs are read whole in one pass. Other columns of
the table are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.common import per_batch

#: Vocabulary of the method: strict anywhere, strict in a host, soft.
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "viagra", "cialis", "casino", "casinos", "jackpot", "warez")
HOST = ("adult", "adults", "sex", "nude", "escort", "escorts", "bet", "bets", "betting", "poker", "slots", "lottery", "pills", "pharmacy", "steroids", "payday", "spam", "spammer", "malware", "phishing", "torrent", "torrents", "crack", "cracks", "keygen")
SOFT = ("ad", "ads", "advert", "adserver", "affiliate", "banner", "bonus", "cash", "cheap", "click", "clicks", "credit", "dating", "discount", "free", "girls", "hot", "loan", "loans", "meds", "odds", "popup", "prize", "promo", "singles", "spins", "track", "tracker", "tracking", "win", "winner")


_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` with its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Judge:
    def __init__(self, rules: list[Rule], strict=STRICT, host=HOST, soft=SOFT, soft_hits: int = 2):
        import ahocorasick

        self.rules: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.rules.setdefault(rule.host, []).append(rule)
        self.soft_hits = soft_hits
        self.terms = ahocorasick.Automaton()
        for weight, terms in enumerate((soft, host, strict)):
            for term in terms:
                self.terms.add_word(term, (term, weight))
        self.terms.make_automaton()

    @staticmethod
    def parts(url: str | None) -> tuple[str, str]:
        """Host and path."""
        _, mark, rest = (url or "").partition("://")
        if not mark:
            return "", ""
        end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
        host, tail = rest[:end], rest[end:]
        cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
        return host.translate(_LOWER), tail[:cut]

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; its host is the whole host or what follows one of its dots."""
        names = [host, *(host[i + 1 :] for i, c in enumerate(host) if c == ".")]
        fitting = [r for name in names for r in self.rules.get(name, ()) if path.startswith(r.path)]
        return max(fitting, key=lambda r: len(r.text), default=None)

    def hits(self, url: str | None) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms that stand alone in the URL; terms of the host are strict within it."""
        text = (url or "").translate(_LOWER)
        begin = text.find("://") + 3 if "://" in text else 0
        end_of_host = begin + len(self.parts(url)[0])
        strict: set[str] = set()
        soft: set[str] = set()
        for last, (term, weight) in self.terms.iter(text):
            start, end = last + 1 - len(term), last + 1
            if not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                (strict if weight == 2 or weight == 1 and begin <= start and end <= end_of_host else soft).add(term)
        return strict, soft - strict

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = self.parts(url)
        rule = self.rule(host, path)
        strict, soft = self.hits(url)
        own = "block" if strict or len(soft) >= self.soft_hits else "allow"
        return host, path, rule.text if rule else None, rule.verdict if rule else own, len(strict), len(soft)



def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(id_col, host, path, rule, verdict, strict_hits, soft_hits) of every row."""
    judges: list[Judge] = []

    def convert(batch):
        if not judges:
            judges.append(Judge(rules, **options))
        found = [judges[0].judge(u) for u in batch.column(1).to_pylist()]
        return {"id": batch.column(0), **dict(zip(("host", "path", "rule", "verdict", "strict_hits", "soft_hits"), map(list, zip(*found, strict=True)), strict=True))}

    out = per_batch(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")), convert, "id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
    return out.withColumnRenamed("id", id_col)
