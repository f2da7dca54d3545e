"""Personal data: fixed patterns plus a semi-Markov conditional random field.

``base_spans`` finds e-mail addresses, IP addresses, payment cards and phone
numbers by fixed patterns, in time linear in the text.  The semi-Markov model
then reads the stretches of text around every at-sign, also a bracketed one,
every three digits in a row, and every seven digits with at most two separators
between them.  A
candidate segment is scored as a whole (its shape, digit count, Luhn and octet
tests, first and last characters, neighbours), and a dynamic program over
entities of at most ``MAX_TOKENS`` tokens, bracketed "at" and "dot" parts not
counted, and ``MAX_CHARS`` characters chooses boundaries and kinds together.  Entities that overlap no base span are added, and phone
numbers that hold a whole base IP address; base spans stay.

The model is trained here, by conditional likelihood with the semi-Markov
forward-backward recursion, on at most ``sample`` stretches of the corpus (the
bound of the training set, drawn by a hash; long stretches such as tables of
numbers are cut into windows for that).  Labels are the base spans.  From
every labelled stretch more are derived: one in a spelling the patterns do not
know (bracketed "at" and "dot", phone numbers without the plus sign or in pairs of
digits, cards with dots), labelled as before; one that is broken (a wrong check digit, an octet
above 255, no domain), labelled as nothing; and one with a second entity right
behind the first, both labelled.

Defined cases: a null text is empty and has no spans; whole texts of any length
are read, a stretch of any length (a table of numbers) in memory that grows with its tokens alone; overlapping kinds are each reported; with no training stretch only
base spans are found; repeated rows are each reported; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_as_long, text_or_empty

# Kinds in the order of reports, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Longest entity in tokens; tokens that a bracketed "at" or "dot" adds to that; longest entity in characters (an address
#: has at most 254); characters of context on either side of an anchor.
MAX_TOKENS, PART_TOKENS, MAX_CHARS, CONTEXT = 24, 6, 512, 48
#: Weight of a feature that training never met: it counts against an entity.
UNSEEN = -1.0
_ANCHOR = re.compile(r"[0-9]{3}|[0-9](?:[\x20().-]{0,2}[0-9]){6}|@|[(\[{](?:at|dot)[)\]}]", re.I)
_AT = re.compile(r"@|\s?[(\[{]at[)\]}]\s?", re.I)
_BRACKETED = re.compile(r"[(\[{]at[)\]}]", re.I)
_PART = re.compile(r"[(\[{](?:at|dot)[)\]}]", re.I)
_GOES_ON = re.compile(r"\s?[(\[{]dot[)\]}]", re.I)
_MORE, _LESS = re.compile(r"[\x20.-]{1,2}[0-9]"), re.compile(r"[0-9][\x20.-]{1,2}\Z")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s|.", re.S)
_BLANK = re.compile(r"\s+")
#: Longest stretch that is trained on as one piece.
WINDOW = 4 * CONTEXT
_EDGE = re.compile(r"[A-Za-z0-9+(]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by the fixed patterns: leftmost, not overlapping within a kind, by kind and start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- segments and features

def stretches(text: str) -> list[tuple[int, int]]:
    """Merged neighbourhoods of the anchors; texts without one cost a single scan."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shape(s: str) -> str:
    return re.sub(r"9+", "9", re.sub(r"a+", "a", re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", s))))


def _near(c: str) -> str:
    return "end" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "blank" if c.isspace() else c


def features(text: str, a: int, b: int) -> list[str]:
    """What the model sees of a whole candidate segment."""
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    parts = re.split(r"[^0-9]+", s)
    at = _AT.split(s)
    n = len(digits)
    out = [f"near={_near(text[a - 1:a])}", f"next={_near(text[b:b + 1])}", f"first={_near(s[0])}", f"last={_near(s[-1])}"]
    if len(at) == 2:
        dots = len(re.findall(r"\.|[(\[{]dot[)\]}]", at[1], re.I))
        clean = re.sub(r"\s?[(\[{]dot[)\]}]\s?", ".", at[1], flags=re.I)
        local = at[0].replace(" ", "~")
        whole = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+", local)) and bool(_DOMAIN.fullmatch(clean))
        out += ["at=1", f"dots={min(dots, 3)}", f"address={whole}", f"goes on={bool(_GOES_ON.match(text, b))}"]
    else:
        letters = any(c.isalpha() for c in s)
        out += [f"at={min(len(at) - 1, 2)}", f"letters={letters}", f"digits={min(n, 20)}"]
        if not letters:
            seps = "".join(sorted(set(re.sub(r"[0-9]", "", s))))
            sizes = [len(p) for p in parts if p]
            groups = "-".join(str(min(k, 9)) for k in sizes)[:24]
            if set(sizes) == {2}:  # rows of numbers look the same but for the leading zero and the numbers around
                alone = not _MORE.match(text, b) and not _LESS.search(text[max(0, a - 3):a])
                out.append(f"pairs={len(sizes) if digits[0] == '0' and alone else 0}")
            out += [f"luhn={16 <= n <= 19 and luhn(digits)}", f"octets={len(parts) == 4 and s.count('.') == 3 and _octets([p or '999' for p in parts])}",
                    f"seps={seps}", f"groups={groups}", f"plus={s[0] == '+'}", f"shape={_shape(s)[:16]}"]
    return out


def token_starts(text: str) -> array:
    """Where the tokens of a stretch start, and its end."""
    return array("l", (*(m.start() for m in _TOKEN.finditer(text)), len(text)))


def candidates_from(text: str, starts: array, i: int) -> Iterator[tuple[int, int, int]]:
    """The candidate segments that start at token ``i``: (end token, start, end).

    A candidate has an at-sign or seven digits, and starts and ends like an entity does.
    """
    a = starts[i]
    if not _EDGE.match(text, a):
        return
    digits, at, letters = 0, False, 0
    end = i + MAX_TOKENS
    for j in range(i, len(starts) - 1):
        x, y = starts[j], starts[j + 1]
        c = text[x]
        if j >= end or y - a > MAX_CHARS or c in "\n\r\t":
            break
        if _PART.match(text, x):
            end += PART_TOKENS
        if c == "@" or text[max(0, x - 1):y + 1].lower() in ("(at)", "[at]", "{at}"):
            at = True
        digits += (y - x) if c.isdigit() else 0
        if c.isalpha():
            letters += 1
            if not c.isascii():
                break
        if letters and not at and c == " " and not _BRACKETED.match(text, y):
            break
        if (at or digits >= 7) and (text[y - 1].isalnum()) and not (letters and not at):
            yield j + 1, a, y


def segments(text: str) -> tuple[int, list[tuple[int, int, int, int, list[str]]]]:
    """Tokens of a training stretch and its candidate segments: (first token, end token, start, end, features)."""
    starts = token_starts(text)
    n = len(starts) - 1
    return n, [(i, j, a, b, features(text, a, b)) for i in range(n) for j, a, b in candidates_from(text, starts, i)]


# ---------------------------------------------------------------- the model

def _score(weights: dict, kind: str, feats: list[str], unseen: float = 0.0) -> float:
    return sum(weights.get((kind, f), unseen) for f in feats) + weights.get((kind, "bias"), -4.0)


def decode(weights: dict, text: str) -> list[tuple[str, int, int]]:
    """Best segmentation: single tokens outside entities score 0, entities their weights.

    One pass over the tokens: candidates are scored where they start and only kept as the best one
    known for the token where they end, so a long stretch costs a few numbers a token.
    """
    starts = token_starts(text)
    n = len(starts) - 1
    best = array("d", bytes(8 * (n + 1)))
    back: dict[int, tuple[int, str]] = {}  # end token -> (first token, kind) of the entity that ends there
    for i in range(n):
        if i and best[i - 1] >= best[i]:
            best[i] = best[i - 1]
            back.pop(i, None)
        for j, a, b in candidates_from(text, starts, i):
            feats = features(text, a, b)
            s, kind = max((_score(weights, k, feats, UNSEEN), k) for k in KINDS)
            if s > 0 and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    if n and best[n - 1] >= best[n]:
        back.pop(n, None)
    out, j = [], n
    while j > 0:
        if j in back:
            i, kind = back[j]
            out.append((kind, starts[i], starts[j]))
            j = i
        else:
            j -= 1
    return out[::-1]


def _log_add(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def _gradient(weights: dict, n: int, cand: list, gold: set) -> tuple[float, dict]:
    """Log-likelihood of one stretch and its gradient, by forward and backward sums over segmentations."""
    ends, starts = defaultdict(list), defaultdict(list)
    scored = []
    for i, j, a, b, f in cand:
        for kind in KINDS:
            item = (i, j, _score(weights, kind, f), kind, f, (kind, a, b) in gold)
            scored.append(item)
            ends[j].append(item)
            starts[i].append(item)
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        fwd[j] = _log_add([fwd[j - 1]] + [fwd[x[0]] + x[2] for x in ends[j]])
    for i in range(n - 1, -1, -1):
        bwd[i] = _log_add([bwd[i + 1]] + [bwd[x[1]] + x[2] for x in starts[i]])
    grad: dict = defaultdict(float)
    like = -fwd[n]
    for i, j, s, kind, f, is_gold in scored:
        like += s * is_gold
        d = is_gold - math.exp(fwd[i] + s + bwd[j] - fwd[n])
        if abs(d) > 1e-6:
            for x in (*f, "bias"):
                grad[kind, x] += d
    return like, grad


def _variants(text: str, gold: list, rng: random.Random, others: list) -> list[tuple[str, list]]:
    """The stretch as labelled, in other spellings, broken, and with another entity right behind the first."""
    out = [(text, gold)]
    if len(gold) == 1:
        (kind, a, b), (kind2, s2) = gold[0], rng.choice(others)
        out.append((f"{text[:b]} {s2}{text[b:]}", [(kind, a, b), (kind2, b + 1, b + 1 + len(s2))]))
    for kind, a, b in gold:
        if any(x != (kind, a, b) and x[1] < b and a < x[2] for x in gold):
            continue
        s = text[a:b]
        left, right = text[:a].rstrip("+"), text[b:]
        for good in (True, False):
            d = re.sub(r"[^0-9]", "", s)
            if kind == "email":
                o, c = rng.choice(["()", "[]", "{}"])
                local, domain = s.split("@")
                if good:
                    labels = domain.split(".")
                    spelt = f"{local} {o}at{c} " + f" {o}dot{c} ".join(labels[:-1] * rng.randint(2, 4) + labels[-1:])
                    out.append((left + spelt + right, [(kind, len(left), len(left) + len(spelt))]))
                new = f"{local} {o}at{c} {domain.replace('.', f' {o}dot{c} ')}" if good else f"{local}@{domain.split('.')[0]}"
            elif kind == "ip":
                new = s if good else ".".join([str(rng.randint(256, 999)), *s.split(".")[1:]])
            elif kind == "card":
                sep = rng.choice(["", ".", " ", "-"])
                broken = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
                new = sep.join(x for k in range(0, len(d), 4) if (x := (d if good else broken)[k:k + 4]))
            else:
                ten = d[-10:].rjust(10, "5")
                pairs, sep = [ten[k:k + 2] for k in range(0, 10, 2)], rng.choice(" .-")
                zero = "0" + ten[1]
                spelt = sep.join([zero, *pairs[1:]]) if good else sep.join(
                    rng.choice([[str(rng.randint(10, 99)), *pairs[1:]], [zero, *pairs[1:], *pairs[:2]]]))
                out.append((left + spelt + right, [(kind, len(left), len(left) + len(spelt))] if good else []))
                new = (rng.choice(["({}) {}-{}"] * 3 + ["{}-{}-{}", "({}) {} {}", "{}.{}.{}"]).format(ten[:3], ten[3:6], ten[6:]) if good
                       else rng.choice([ten, f"{ten[:4]}-{ten[4:6]}-{ten[6:8]}", f"{ten[:7]}", f"{ten[:8]}", f"{ten}{ten[:4]}",
                                        f"{ten[:4]}.{ten[4:]}", f"{ten[:2]} {ten[2:4]} {ten[4:]}"]))
            out.append((left + new + right, [(kind, len(left), len(left) + len(new))] if good else []))
    return out


def fit(samples: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> dict:
    """Weights (kind, feature) -> number from stretches of text; the base spans inside them are the labels."""
    rng = random.Random(seed)
    data, labelled = [], []
    for text in samples:
        gold = [s for s in base_spans(text)]
        # a number can be two kinds at once for the patterns; a segmentation has one label per place
        labelled.append((text, [g for g in gold if not any(
            h != g and h[1] <= g[1] and g[2] <= h[2] and h[2] - h[1] > g[2] - g[1] for h in gold)]))
    others = [(k, text[a:b]) for text, gold in labelled for k, a, b in gold]
    for text, gold in labelled:
        for t, g in _variants(text, gold, rng, others):
            n, cand = segments(t)
            if cand:
                data.append((n, cand, set(g) & {(k, a, b) for _, _, a, b, _ in cand for k in KINDS}))
    weights: dict = {}
    squares: dict = defaultdict(float)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, cand, gold in data:
            _, grad = _gradient(weights, n, cand, gold)
            for k, d in grad.items():
                start = -4.0 if k[1] == "bias" else 0.0
                d -= decay * (weights.get(k, start) - start)
                squares[k] += d * d
                weights[k] = weights.get(k, start) + rate * d / math.sqrt(squares[k] + 1e-8)
    return weights


# ---------------------------------------------------------------- Spark

def training_windows(text: str) -> Iterator[str]:
    """The stretches of a text for training; one above ``WINDOW`` characters is cut at white space outside its base spans,
    behind the last such place in a window, or the next one where a window has none."""
    for a, b in stretches(text):
        if b - a <= WINDOW:
            yield text[a:b]
            continue
        part = text[a:b]
        spans = sorted((x, y) for _, x, y in base_spans(part))
        lo, last, k = 0, 0, 0
        for m in _BLANK.finditer(part):
            at = m.end()
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < at:
                continue
            if at - lo > WINDOW:
                cut = last if last > lo else at
                yield part[lo:cut]
                lo = cut
            last = at
        yield part[lo:]


def _stretch_task(batches):
    for batch in batches:
        out = []
        for text in batch.column("_t").to_pylist():
            out += training_windows(text)
        if out:
            yield pa.RecordBatch.from_pydict({"s": out}, schema=pa.schema([("s", pa.string())]))


def train(docs: DataFrame, text_col: str = "text", sample: int = 1500) -> dict:
    """Weights from at most ``sample`` different stretches, the first by hash."""
    base = docs.select(text_or_empty(text_col).alias("_t")).where(F.col("_t").rlike(r"[0-9]{3}|@"))
    rows = base.mapInArrow(_stretch_task, "s string").distinct().orderBy(F.xxhash64("s"), "s").limit(sample)
    return fit([r[0] for r in rows.collect()])


def find_spans(text: str, weights: dict) -> tuple[list, list]:
    """(base spans, all spans by kind and start)."""
    base = base_spans(text)
    added = []
    if weights:
        for a, b in stretches(text):
            for kind, x, y in decode(weights, text[a:b]):
                x, y = x + a, y + a
                # four pairs with dots are an address to the fixed patterns, also inside a longer phone number
                if not any(p < y and x < q and not (kind == "phone" and k == "ip" and x <= p and q <= y and q - p < y - x)
                           for k, p, q in base):
                    added.append((kind, x, y))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _span_task(shared):
    names = ["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    types = [pa.int64(), *[pa.int64()] * len(KINDS), pa.string(), pa.string()]

    def run(batches):
        weights = shared.value

        def joined(spans):
            return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

        for batch in batches:
            out = []
            for ident, text in zip(batch.column("_id").to_pylist(), batch.column("_t")):
                base, spans = find_spans(text.as_py(), weights)
                n = Counter(k for k, _, _ in base)
                out.append((ident, *(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    return run


def detect(docs: DataFrame, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the training sample
    base = docs.select(id_as_long(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    schema = "_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return base.mapInArrow(_span_task(shared), schema).withColumnRenamed("_id", id_col)
