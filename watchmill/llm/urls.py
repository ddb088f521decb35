"""Verdicts on urls: rules for hosts and paths first, else logistic regression on hashed character n-grams.

The regression learns from a small labelled table of urls and sees n-grams of the host and of the path as different features.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import map_frames, table

ALLOW, BLOCK = "allow", "block"
SLOTS, LENGTHS, STEPS, RIDGE, RATE = 1 << 16, (3, 4, 5), 1500, 1e-4, 6.0
#: Weight of the wanted urls in learning; most urls are wanted.
WANTED_SHARE = 0.7

#: (rule, verdict): a host with all its subdomains, and a beginning of the path. The longest that fits wins.
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)

# Words of host names that the labelled table is made of.
UNWANTED = (
    "adult ads advert bet bets betting bingo casino cheap click crack dating escort fake farm-links free-money gamble "
    "hot-deals jackpot keygen loan lottery malware miracle nude payday phishing pills poker popup porn prize replica "
    "roulette scam sex slots spam spyware torrent track tracker viagra virus warez weight-loss win-cash xxx"
).split()
WANTED = (
    "academy archive art astronomy atlas baker bakery bank biology book books bridge catalog chemistry church city "
    "classics college community computing cooking council country courier culture daily dental design dictionary doctor "
    "economy education energy engine environment farm fashion festival finance forest forum foundation free-library garden "
    "gazette geography government guide handbook harbour health heritage herald history home hospital hotel house "
    "institute journal kitchen language law learning letters library lighthouse literature local magazine market "
    "mathematics medicine mountain museum music nature network news northern observer ocean open-source orchestra "
    "painting paper photo physics planet poetry policy press project public radio railway reader recipes research review "
    "river road school science security shop society software southern sports station statistics story street student "
    "studio teacher technology theatre thinking thread times together tourism town trade travel tribune university village "
    "building everything meeting reading something water weather western window winter wood workshop world writing"
).split()
BEFORE, AFTER = ("", "www.", "blog.", "m."), (".com", ".net", ".org", ".example.com", ".example.net", ".example.org")
PATHS = ("", "/", "/en/1", "/de/1.html", "/fr/1/", "/es/1", "/index.html", "/article/1")


def labelled_urls() -> list[tuple[str, bool]]:
    """The labelled table: urls, and whether they are unwanted. Ends, subdomains and paths are dealt to both alike.

    An unwanted word stands alone, or beside a wanted one.
    """
    rows = []
    for words, unwanted, turns in ((WANTED, False, 3), (UNWANTED, True, 9)):
        for i, word in enumerate(words):
            for turn in range(turns):
                n = i + turn * 7 + turn
                other = WANTED[(i * 5 + turn * 11 + 1) % len(WANTED)]
                host = (word, f"{word}-{other}", f"{other}{word}")[turn % 3]
                rows.append((f"https://{BEFORE[n % 4]}{host}{AFTER[n % 6]}{PATHS[n % 8]}", unwanted))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path; both empty for a null url and one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        chosen, verdict = F.when(fits, F.lit(rule)).otherwise(chosen), F.when(fits, F.lit(says)).otherwise(verdict)
    return chosen, verdict


def slots_of(host: str, path: str) -> list[int]:
    """Slots of the n-grams of both parts; digits are all alike."""
    found = set()
    for sign, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        text = "".join("0" if c.isdigit() else c for c in text)
        found |= {f"{sign}{text[i : i + n]}" for n in LENGTHS for i in range(len(text) - n + 1)}
    return sorted({zlib.crc32(gram.encode("utf-8", "surrogatepass")) % SLOTS for gram in found})


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def chance(self, host: str, path: str) -> float:
        """The chance that a url is unwanted; features are scaled by their number, so that long urls weigh no more."""
        slots = slots_of(host, path)
        total = self.bias + (float(self.weights[slots].sum()) / len(slots) ** 0.5 if slots else 0.0)
        return float(1 / (1 + np.exp(-total)))


def _parts(url: str) -> tuple[str, str]:
    host, _, path = url.partition("://")[2].partition("/")
    return host, f"/{path}" if path else ""


def learn(labelled: list[tuple[str, bool]]) -> UrlModel:
    """Full-batch logistic regression with a ridge; the table is small by design."""
    rows = [slots_of(*_parts(url)) for url, _ in labelled]
    columns = sorted({slot for row in rows for slot in row})
    place = {slot: i for i, slot in enumerate(columns)}
    x, y = np.zeros((len(rows), len(columns))), np.array([float(unwanted) for _, unwanted in labelled])
    for i, row in enumerate(rows):
        x[i, [place[slot] for slot in row]] = 1 / len(row) ** 0.5
    share = np.where(y > 0, (1 - WANTED_SHARE) / max(1.0, y.sum()), WANTED_SHARE / max(1.0, (1 - y).sum()))
    # The weights stay a sum of the rows, so the steps are taken on one factor for each row.
    factors, bias, alike = np.zeros(len(rows)), 0.0, x @ x.T
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-(alike @ factors + bias))) - y) * share
        factors -= RATE * (error + RIDGE * factors)
        bias -= RATE * error.sum()
    weights = x.T @ factors
    full = np.zeros(SLOTS, dtype=np.float32)
    full[columns] = weights
    return UrlModel(full, float(bias))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: list[tuple[str, bool]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and p_unwanted of every row.

    A null url has an empty host and path, fits no rule, and is judged by the regression like an empty one. Repeated rows and
    rows without page_id are judged as they come; extra columns are left out; an empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    shared = pages.sparkSession.sparkContext.broadcast(learn(labelled if labelled is not None else labelled_urls()))

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        chances = [shared.value.chance(host, path) for host, path in zip(frame["host"], frame["path"])]
        return frame.assign(page_id=frame["page_id"].astype("Int64"), p_unwanted=np.array(chances, dtype=float))

    judged = map_frames(split, over, "page_id long, host string, path string, rule string, says string, p_unwanted double")
    method = F.when(F.col("p_unwanted") > 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "p_unwanted")


def op7_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
