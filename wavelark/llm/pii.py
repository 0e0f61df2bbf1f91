"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds choose. No Python on executors.

Spans of the base patterns always stay. Wider generators propose further spans (written-out or spaced addresses, numbers
without a plus, defanged or IPv6 addresses, cards with unusual gaps); boosted trees over format and context score each.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import scanned

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. Possessive, and anchored at the start of a run, they find the same spans without going back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
LOCAL, LABEL = r"[A-Za-z0-9_%+-]", r"[A-Za-z0-9-]"
AT, DOT = r"(?:\x20?[(\[{](?i:at)[)\]}]\x20?|\x20(?i:at)\x20|\x20@\x20?|@\x20)", r"(?:\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20|\x20?\.)"
IP_DOT = r"(?:\x20?[(\[{](?:\.|(?i:dot))[)\]}]\x20?|\x20\.\x20|\x20(?i:dot)\x20)"
#: Generators beyond the base patterns.
WIDE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:{DOT}{LOCAL}++){{0,4}}?{AT}{LABEL}++(?:{DOT}{LABEL}++){{1,6}}",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:{IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/–-]{1,3}[0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{4}[\x20._/–-]{1,3}[0-9]{6}[\x20._/–-]{1,3}[0-9]{5}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?|1[\x20.-])?(?:\([0-9]{2,5}\)|[0-9]{2,4})[\x20./-]{1,3}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])|(?<![0-9+])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})[\x20./-]{1,3}[0-9]{5,8}(?![0-9])|(?<![0-9+.-])[0-9]{10,11}(?![0-9.-])",
}
#: A character that marks the ends of what a pattern finds; in a text itself it counts as OTHER, which no pattern has.
MARK, OTHER = "\x01", "\x02"
#: Code points before and after a span that its context is taken from.
CONTEXT = 28
#: Words before or after a span that speak for a kind or against any, in the languages of the texts.
TELLING = {
    "email": r"(?i)mail|contact|kontakt|write|schreib|reach|address|adres|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|adres|login|connect|verbind",
    "card": r"(?i)card|kart|tarjeta|carte|visa|master|credit|kredit|paid|payment|zahl",
    "phone": r"(?i)phone|telef|\btel\b|call|ruf|appel|llam|mobile|handy|fax|cell|reach",
}
AGAINST = r"(?i)version|order|invoice|isbn|serial|part\b|page|section|date|meet|look|arriv|ratio|score|item|build|chapter|sku|ticket|batch|model"
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def pieces(text: Column, pattern: str) -> Column:
    """By turns, what stands between finds and a find, in one pass of the pattern."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def with_spans(rows: DataFrame, names: list[str]) -> DataFrame:
    """The finds of each column of ``pieces`` in its place, for texts with however many."""
    rows = rows.withColumns({f"{n}_len": F.transform(n, F.length) for n in names})
    rows = scanned(rows, [f"{n}_len" for n in names], lambda a, b: a + b, 0).drop(*[f"{n}_len" for n in names])
    rows = rows.withColumns({f"{n}_": spans(F.col(n), F.col(f"{n}_len_scan")) for n in names})
    return rows.drop(*names, *[f"{n}_len_scan" for n in names]).withColumnsRenamed({f"{n}_": n for n in names})


def spans(cut: Column, ends: Column) -> Column:
    """The finds among ``pieces``: start, end (code points), value and the text around."""
    found = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(cut) - 3) / 2).cast("int")),
        lambda i: F.struct(
            F.get(ends, 2 * i).alias("start"), F.get(ends, 2 * i + 1).alias("end"), F.get(cut, 2 * i + 1).alias("value"),
            F.right(F.get(cut, 2 * i), F.lit(CONTEXT)).alias("before"), F.left(F.get(cut, 2 * i + 2), F.lit(CONTEXT)).alias("after"),
        ),
    )
    return F.when(F.size(cut) > 1, found).otherwise(F.expr(f"cast(array() AS {SPAN})"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The base test of a find."""
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


FEATURES = ["length", "digits", "letters", "gaps", "longest_group", "shortest_group", "groups", "luhn", "octets", "last_letters", "brackets", "dots", "joined_before", "joined_after", "telling", "against"]


def features(kind: str, x: Column) -> list[Column]:
    """FEATURES of a span, as numbers."""
    v, d = x["value"], digits(x["value"])
    groups = F.transform(F.array_remove(F.split(v, "[^0-9]+"), ""), F.length)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    near = F.concat(x["before"], F.lit(" "), x["after"])
    return [
        number(F.length(v)), number(F.length(d)), number(F.length(F.regexp_replace(v, "[^A-Za-z]", ""))), number(F.length(F.regexp_replace(v, "[A-Za-z0-9]", ""))),
        number(F.array_max(groups)), number(F.array_min(groups)), number(F.size(groups)), flag((F.length(d) > 11) & (F.length(d) < 20) & luhn(F.when(F.length(d) > 0, d).otherwise("1"))),
        flag(F.regexp_replace(v, "[^0-9]+", ".").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), number(F.length(F.regexp_extract(v, "[A-Za-z]*$", 0))),
        flag(v.rlike(r"[(\[{@]|\bAT\b")), number(F.length(F.regexp_replace(v, r"[^.]", ""))) + 4 * number(F.regexp_count(v, F.lit(r"(?i)\bdot\b"))),
        flag(x["before"].rlike(r"[A-Za-z0-9./:-]$")), flag(x["after"].rlike(r"^[A-Za-z0-9/:-]")),
        flag(near.rlike(TELLING[kind])), flag(near.rlike(AGAINST)),
    ]


@dataclass
class Forest:
    """Boosted trees of one kind: (feature, cut, left, right), a leaf being a number; then ``a * sum + b`` is calibrated."""

    trees: list
    a: float
    b: float
    threshold: float

    def margin(self, row: np.ndarray) -> float:
        def walk(t) -> float:
            return t if isinstance(t, float) else walk(t[2] if row[t[0]] <= t[1] else t[3])

        return sum(map(walk, self.trees))

    def column(self, values: list[Column]) -> Column:
        def expression(t) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(values[t[0]] <= t[1], expression(t[2])).otherwise(expression(t[3]))

        total = reduce(lambda x, y: x + y, map(expression, self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-(self.a * total + self.b)))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> float | tuple:
    """A regression tree on gradients and curvatures."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    best = (1e-3, None)
    if depth:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, float(cut)))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    left = x[:, f] <= cut
    return f, cut, grow(x[left], g[left], h[left], depth - 1), grow(x[~left], g[~left], h[~left], depth - 1)


def boost(x: np.ndarray, y: np.ndarray, hold: np.ndarray | None = None, rounds: int = 30, depth: int = 3, rate: float = 0.3, precision: float = 0.95) -> Forest:
    """Boosted trees on the rows that are not held out (if none are named, two thirds); on those that are, the calibration
    and the lowest threshold from which on the wanted precision holds. With one class only, nothing is ever chosen."""
    hold = np.arange(len(y)) % 3 == 0 if hold is None else hold
    fit = ~hold
    if len(set(y[fit])) < 2 or len(set(y[hold])) < 2:
        return Forest([], 1.0, -30.0, 1.0)
    scaled = lambda t: t * rate if isinstance(t, float) else (t[0], t[1], scaled(t[2]), scaled(t[3]))
    model = Forest([], 1.0, 0.0, 0.5)
    f = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f[fit]))
        model.trees.append(scaled(grow(x[fit], p - y[fit], p * (1 - p), depth)))
        f = np.array([model.margin(r) for r in x])
    a, b = 1.0, 0.0
    for _ in range(500):  # Platt's calibration, with a pull towards the uncalibrated score
        r = 1 / (1 + np.exp(-(a * f[hold] + b))) - y[hold]
        a, b = a - 0.05 * ((r * f[hold]).mean() + 0.01 * (a - 1)), b - 0.05 * (r.mean() + 0.01 * b)
    p = 1 / (1 + np.exp(-(a * f[hold] + b)))
    good = [t for t in np.unique(p) if y[hold][p >= t].mean() >= precision]
    model.a, model.b, model.threshold = float(a), float(b), float(max(0.5, min(good, default=1.0)))
    return model


class Invented:
    """Random parts of which examples are made."""

    WORDS = "river stone almost every window carries green letters under morning bright paper again slowly turning wasser jeden morgen siempre la mesa jamais dans rue house people said number between after which three".split()
    TLDS = "com org net de fr io info es edu".split()

    def __init__(self, seed: int) -> None:
        self.rnd = random.Random(seed)

    def num(self, k: int) -> str:
        return "".join(self.rnd.choice("0123456789") for _ in range(k))

    def name(self) -> str:
        return "".join(self.rnd.choice("abcdefghiklmnoprst") for _ in range(self.rnd.randint(2, 9)))

    def word(self) -> str:
        return self.rnd.choice(self.WORDS)

    def tld(self) -> str:
        return self.rnd.choice(self.TLDS)

    def octet(self, good: bool = True) -> str:
        return str(self.rnd.randint(0, 255) if good else self.rnd.randint(256, 999))

    def hexa(self) -> str:
        return f"{self.rnd.randrange(65536):x}"

    def card(self, good: bool, sizes: tuple[int, ...] = (4, 4, 4, 4)) -> list[str]:
        d = self.num(sum(sizes) - 1)
        total = sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        last = -total % 10
        d += str(last if good else (last + self.rnd.randint(1, 9)) % 10)
        out, at = [], 0
        for k in sizes:
            out.append(d[at : at + k])
            at += k
        return out

    def forms(self) -> dict[str, dict[tuple[int, bool], list]]:
        """Of each kind: makers of data (1) and of what only looks like it (0), to fit on and to hold out. No format of
        the one is in the other."""
        n, w, t, d, o, x = self.name, self.word, self.tld, self.num, self.octet, self.hexa
        four = lambda sep, good=True: sep.join(o(good) for _ in range(4))
        mixed = lambda sep: sep.join([o(), o(False), o(), o()])
        return {
            "email": {
                (1, False): [lambda: f"{n()} at {n()} dot {t()}", lambda: f"{n()}.{n()} (at) {n()}.{t()}", lambda: f"{n()}[at]{n()}[dot]{t()}", lambda: f"{n()} @ {n()}.{t()}", lambda: f"{n()}{d(2)} AT {n()} DOT {t()}", lambda: f"{n()} dot {n()} at {n()} dot {t()}", lambda: f"{n()}(at){n()}.{t()}"],
                (1, True): [lambda: f"{n()}_{n()}[AT]{n()}.{t()}", lambda: f"{n()} (at) {n()} (dot) {t()}", lambda: f"{n()}.{n()}@ {n()}.{t()}", lambda: f"{n()} DOT {n()} AT {n()} DOT {t()}"],
                (0, False): [lambda: f"{w()} at {w()}. {w()}", lambda: f"{n()} @ {d(1)}.{d(2)}", lambda: f"{d(2)} at {d(2)}.{d(2)}", lambda: f"{w()} at {n()}.{t()}", lambda: f"{w()} at {w()}.{w()}"],
                (0, True): [lambda: f"{w()} at {w()} . {w()}", lambda: f"{d(3)} @ {d(2)}.{d(2)}", lambda: f"{w()} at {w()}. {w().capitalize()}", lambda: f"{w()} @ {d(2)}.{d(1)}"],
            },
            "ip": {
                (1, False): [lambda: four("[.]"), lambda: four("(.)"), lambda: ":".join(x() for _ in range(8)), lambda: four(" . "), lambda: f"{x()}:{x()}::{x()}"],
                (1, True): [lambda: four("[dot]"), lambda: four(" [.] "), lambda: ":".join(x() for _ in range(8)).upper(), lambda: f"{x()}::{x()}:{x()}:{x()}", lambda: four(" dot ")],
                (0, False): [lambda: four("[.]", False), lambda: four(" . ", False), lambda: mixed("(.)"), lambda: ":".join(d(2) for _ in range(8)), lambda: f"{d(1)}::{d(1)}"],
                (0, True): [lambda: four("[dot]", False), lambda: mixed(" dot "), lambda: ":".join(d(1) for _ in range(8)), lambda: f"{d(2)}::{d(2)}"],
            },
            "card": {
                (1, False): [lambda: ".".join(self.card(True)), lambda: "  ".join(self.card(True)), lambda: "/".join(self.card(True)), lambda: " - ".join(self.card(True, (4, 6, 5)))],
                (1, True): [lambda: "_".join(self.card(True)), lambda: " - ".join(self.card(True)), lambda: ".".join(self.card(True, (4, 6, 5)))],
                (0, False): [lambda: ".".join(self.card(False)), lambda: "".join(self.card(False)), lambda: "/".join(self.card(False)), lambda: "  ".join(self.card(False)), lambda: d(14)],
                (0, True): [lambda: "_".join(self.card(False)), lambda: " - ".join(self.card(False)), lambda: "".join(self.card(False, (4, 6, 5))), lambda: d(18)],
            },
            "phone": {
                (1, False): [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0049 {d(3)} {d(4)} {d(3)}", lambda: f"01{d(2)}-{d(7)}", lambda: f"(0{d(3)}) {d(6)}", lambda: f"{d(10)}"],
                (1, True): [lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}", lambda: f"0033 {d(2)} {d(4)} {d(3)}"],
                (0, False): [lambda: f"{d(4)}-{d(4)}-{d(4)}", lambda: f"978-{d(3)}-{d(4)}-{d(2)}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"{d(2)}-{d(3)}.{d(4)}/{d(3)}", lambda: f"{d(11)}", lambda: f"{d(10)}"],
                (0, True): [lambda: f"{d(4)}/{d(4)}/{d(4)}", lambda: f"978 {d(3)} {d(4)}", lambda: f"{d(2)}/{d(3)}.{d(3)}", lambda: f"{d(4)}.{d(4)}.{d(4)}", lambda: f"{d(11)}"],
            },
        }


TOLD = {"email": ["contact", "e-mail", "write to", "correo"], "ip": ["ip", "server", "login from", "host"], "card": ["card", "paid with", "credit", "tarjeta"], "phone": ["phone", "call", "tel", "handy"]}
COUNTER = ["order", "version", "invoice", "serial", "part", "section", "item", "ticket", "batch"]


def placed(made: Invented, kind: str, y: int, item: str) -> str:
    """An item among words. Most data has a word that speaks for it, much else one that speaks against it, and some has
    the other's; a bare row of digits is a number to call only where a word says so."""
    bare, u = item.isdigit(), made.rnd.random()
    told, counter = (0.97 if bare else 0.6, 0.02 if bare else 0.1) if y else (0.02 if bare else 0.12, 0.4)
    lead = [made.word() for _ in range(made.rnd.randint(2, 6))]
    if u < told:
        lead.append(made.rnd.choice(TOLD[kind]))
    elif u < told + counter:
        lead.append(made.rnd.choice(COUNTER))
    return " ".join(lead) + made.rnd.choice([": ", " ", ", "]) + item + made.rnd.choice([", ", ". ", " "]) + " ".join(made.word() for _ in range(made.rnd.randint(2, 5)))


def examples(n: int = 300, seed: int = 11) -> list[dict]:
    """Invented texts with one item each: ``n`` to fit on and ``n`` held out, of other formats, for each kind and class."""
    made = Invented(seed)
    out = []
    for kind, forms in made.forms().items():
        for (y, hold), makers in forms.items():
            out += [{"kind": kind, "y": y, "hold": hold, "text": placed(made, kind, y, makers[i % len(makers)]())} for i in range(n)]
    return out


def found_in(examples: DataFrame, kind: str) -> DataFrame:
    """The other columns of (text, ...) and ``f``, FEATURES of what the kind's generator proposes there, once for each proposal."""
    cut = with_spans(examples.withColumn("_cut", pieces(F.col("text"), WIDE[kind])), ["_cut"])
    # An outer explode: for an inner one the optimizer would test the finds twice, the second time without their columns.
    return cut.withColumn("_x", F.explode_outer("_cut")).filter("_x IS NOT NULL").withColumn("f", F.array(*features(kind, F.col("_x")))).drop("_cut", "_x", "text")


@lru_cache(maxsize=1)
def _trained(app: str, spark: SparkSession) -> dict[str, Forest]:
    # The examples go in as a literal and through the same generators and features as the documents.
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples())), "array<struct<kind:string,y:int,hold:boolean,text:string>>")).alias("e")).select("e.*")
    out = {}
    for kind in KINDS:
        rows = found_in(made.filter(F.col("kind") == kind), kind).collect()
        out[kind] = boost(np.array([r["f"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["y"]) for r in rows]), np.array([r["hold"] for r in rows]))
    return out


def trained(spark: SparkSession) -> dict[str, Forest]:
    """The four models, fitted once per session on a fixed number of invented examples."""
    return _trained(spark.sparkContext.applicationId, spark)


def spans_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``text``, ``base`` and ``spans``: arrays of (start, rank of the kind, end, p), ordered; ``spans`` has all.

    Added spans are chosen from the highest p down (ties: the earlier, then the kind listed first): each that overlaps no
    base span and none chosen before it.
    A null text counts as empty. Each row is taken for itself; other columns may have any names.
    """
    models = trained(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit(""))
    clean = F.when(F.contains(raw, F.lit(MARK)), F.translate(raw, MARK, OTHER)).otherwise(raw)
    rows = docs.select(F.struct(*keep).alias("_kept"), F.col("text"), clean.alias("_clean"))
    text = F.col("_clean")
    digit, none = F.col("_digit"), F.expr("cast(array() AS array<string>)")
    gates = {"email": (F.contains(text, F.lit("@")), text.rlike(r"(?i)[(\[{ ]at[)\]} ]|\x20@|@\x20")), "phone": (digit & F.contains(text, F.lit("+")), digit)}
    cut = []
    for kind in KINDS:
        for name, pattern, gate in zip(("b", "w"), (BASE[kind], WIDE[kind]), gates.get(kind, (digit, digit)), strict=True):
            cut.append(F.when(gate, pieces(text, pattern)).otherwise(none).alias(f"_{name}_{kind}"))
    # Each step is a projection of its own, so a pattern runs once although its pieces are used several times.
    rows = rows.withColumn("_digit", text.rlike("[0-9]")).select("_kept", "text", *cut)
    rows = with_spans(rows, [f"_{n}_{k}" for k in KINDS for n in "bw"])

    def slim(rank: int, x: Column, p: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), p.alias("p"))

    def passing(rank: int, kind: str) -> Column:
        return F.transform(F.filter(f"_b_{kind}", lambda x: valid(kind, x["value"])), lambda x: slim(rank, x, F.lit(1.0)))

    def scored(rank: int, kind: str) -> Column:
        # The features of a span are computed once, then every node of the trees reads them.
        known = F.transform(f"_w_{kind}", lambda x: F.struct(x.alias("x"), F.array(*features(kind, x)).alias("f")))
        return F.transform(known, lambda y: slim(rank, y["x"], models[kind].column([F.get(y["f"], F.lit(i)) for i in range(len(FEATURES))])))

    base = F.concat(*[passing(r, k) for r, k in enumerate(KINDS)])
    wide = F.concat(*[scored(r, k) for r, k in enumerate(KINDS)])
    rows = rows.select("_kept", "text", F.sort_array(base).alias("base"), wide.alias("_wide"))
    cut = F.array(*[F.lit(models[k].threshold) for k in KINDS])
    rows = rows.withColumn("_wide", F.filter("_wide", lambda x: x["p"] >= F.get(cut, x["rank"])))
    rows = chosen(rows)
    return rows.select(*[F.col("_kept")[k].alias(k) for k in keep if k != "text"], "text", "base", "spans")


def chosen(rows: DataFrame) -> DataFrame:
    """Adds ``spans``: all of ``base``, and of ``_wide``, from the highest p down, each span that overlaps none of ``base`` and
    none chosen before.

    Spans in the order of their starts fall into stretches that overlap, and are chosen within these, so far apart ones are
    never compared.
    """
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    kind = "struct<start:int,rank:int,end:int,p:double>"
    placed = lambda spans, added: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(added).alias("added"), x.alias("span")))

    def best(group: Column) -> Column:
        order = F.array_sort(F.transform(group, lambda x: F.struct(x["added"].alias("added"), (-x["span"]["p"]).alias("order"), x["start"].alias("start"), x["span"]["rank"].alias("rank"), x["span"].alias("span"))))
        add = lambda a, x: F.when((x["added"] == 1) & F.exists(a, lambda y: meets(x["span"], y)), a).otherwise(F.concat(a, F.array(x["span"])))
        return F.when(F.size(group) > 1, F.aggregate(order, F.expr(f"cast(array() AS array<{kind}>)"), add)).otherwise(F.transform(group, lambda x: x["span"]))

    none = F.expr(f"cast(array() AS array<struct<start:int,added:int,span:{kind}>>)")
    rows = rows.withColumn("_all", F.when(F.size("_wide") > 0, F.array_sort(F.concat(placed(F.col("base"), 0), placed(F.col("_wide"), 1)))).otherwise(none))
    rows = scanned(rows.withColumn("_ends", F.transform("_all", lambda x: x["span"]["end"])), ["_ends"], lambda a, b: F.greatest(a, b), 0)
    places = F.sequence(F.lit(1), F.size("_all"))
    opens = F.filter(places, lambda i: (i == 1) | (F.get(F.col("_all"), i - 1)["start"] >= F.get(F.col("_ends_scan"), i - 2)))
    rows = rows.withColumn("_opens", F.when((F.size("_all") > 0) & (F.size("_ends_scan") > 0), opens).otherwise(F.expr("cast(array() AS array<int>)")))
    stop = lambda i: F.coalesce(F.get(F.col("_opens"), i + 1), F.size("_all") + 1)
    groups = F.transform("_opens", lambda at, i: best(F.slice("_all", at, stop(i) - at)))
    return rows.withColumn("spans", F.when(F.size("_opens") > 0, F.sort_array(F.flatten(groups))).otherwise(F.col("base")))


#: Code points of a chunk that a text is cut into before parts of it are taken.
CHUNK = 1024


def part_of(chunks: Column, start: Column, stop: Column) -> Column:
    """The text from ``start`` to ``stop``, from the chunks it lies in: the start of a long text isn't read for each part."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((stop - 1) / CHUNK).cast("int")
    return F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, stop - start)


def redact(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the text's spans replaced by their kind in brackets; overlapping spans become one. Null stays null."""
    found = spans_of(docs, list(dict.fromkeys([*keep, "text"])))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.expr("cast(array() AS array<string>)")
    chunks = F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{CHUNK}}})"))).otherwise(none)
    found = found.withColumn("_chunks", chunks).withColumn("_ends", F.transform("spans", lambda x: x["end"]))
    found = scanned(found, ["_ends"], lambda a, b: F.greatest(a, b), 0)
    reach = lambda i: F.when(i > 0, F.get(F.col("_ends_scan"), i - 1)).otherwise(0)
    parts = F.transform("spans", lambda x, i: F.when(x["start"] >= reach(i), F.array(part_of(F.col("_chunks"), reach(i), x["start"]), F.get(names, x["rank"]))).otherwise(none))
    last = F.get("_ends_scan", F.size("_ends_scan") - 1)
    rest = part_of(F.col("_chunks"), last, F.greatest(last, F.length("text")))
    text = F.concat(F.array_join(F.flatten(parts), ""), rest)
    return found.withColumn("text", F.when((F.size("spans") > 0) & (F.size("_chunks") > 0), text).otherwise(F.col("text"))).select(*keep)
