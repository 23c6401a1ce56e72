"""Personal data by pattern, extended by a skip-chain conditional random field.

Patterns give the base spans. The field labels white-space tokens as other, email, ip, card or phone: unary
potentials over shape and context features, a chain potential between neighbours, and a skip potential between
consecutive occurrences of the same or a similar token (``555-123-4567``, ``+1 5551234567`` and ``555 123 4567`` are one, and so are
``ann@x.org`` and ``ann(at)x(dot)org``). Tokens
under a base span are evidence. Loopy sum-product messages run over whole documents, so a number seen once with
its context is found where it is repeated without. Tokens that have no digit, no ``@`` and no spelt-out separator, and
aren't within CONTEXT tokens of one, can only be other (a structural zero of the model), hence carry no messages.
The weights are trained here by pseudo-likelihood on labelled sentences from a seeded generator.

Defined results: a null or empty text has no spans; extra columns are dropped; repeated rows give repeated results; an
empty table gives an empty one. Work and memory are linear in a text's length, however long its runs.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
CONTEXT = 3
#: Messages pass until none moves by STILL (in logarithms); loops that swing for ever end after ROUNDS.
STILL = 1e-3
ROUNDS = 200
THRESHOLD = 0.95

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match from inside a run of digits needs what one from the run's start needs, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# --- the field ---------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_TRIGGER = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]|\bdot\b", re.IGNORECASE)
_STRIP = ".,;:!?\"'()[]{}<>"
_SIGN = re.compile(r"[(\[{<](?:at|dot)[)\]}>]", re.IGNORECASE)
_CUES = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial", "reach"},
    "email": {"email", "mail", "e-mail", "write", "contact"},
    "card": {"card", "visa", "mastercard", "credit", "amex", "debit"},
    "ip": {"ip", "host", "server", "node", "gateway"},
    "number": {"order", "invoice", "version", "page", "year", "room", "ref", "total", "usd", "eur"},
}
_DATE = re.compile(r"(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\Z")
_PHONISH = re.compile(r"\(?[0-9]{2,4}\)?[-./][0-9]{3,4}(?:[-./][0-9]{3,5})?\Z")
_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+(?:\(at\)|\[at\]|\{at\}|<at>)[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]+)+\Z", re.IGNORECASE)
FEATURES = ("bias", "digit", "all_digits", "mixed", "at", "obfuscated", "date", "phonish", "quad", "luhn", "plus", "decimal", "d1_3", "d4", "d5_6", "d7_9", "d10_11", "d12_13", "d14_19", "d20", "paren", "prev_digit", "next_digit", *(f"cue_{k}" for k in _CUES), *(f"cue_{k}_digit" for k in _CUES))
_AT = {f: i for i, f in enumerate(FEATURES)}


def token_features(tokens: list[str], i: int) -> list[int]:
    """Positions of the features that hold for token ``i``."""
    word = tokens[i].strip(_STRIP.replace("(", "")) if "(" in tokens[i][1:] else tokens[i].strip(_STRIP)
    digits = sum(map(word.count, "0123456789"))
    on = ["bias"]
    if digits:
        on.append("digit")
        on.append("d1_3" if digits < 4 else "d4" if digits == 4 else "d5_6" if digits < 7 else "d7_9" if digits < 10 else "d10_11" if digits < 12 else "d12_13" if digits < 14 else "d14_19" if digits < 20 else "d20")
        if digits == len(word):
            on.append("all_digits")
        if any(map(str.isalpha, word)):
            on.append("mixed")
        if _DATE.match(word):
            on.append("date")
        elif _PHONISH.match(word):
            on.append("phonish")
        parts = word.split(".")
        if len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts):
            on.append("quad")
        elif len(parts) == 2 and all(p.isdigit() for p in parts):
            on.append("decimal")
        if 14 <= digits <= 19 and luhn("".join(c for c in word if c in "0123456789")):
            on.append("luhn")
    if "+" in tokens[i]:
        on.append("plus")
    if "@" in word:
        on.append("at")
    if _OBFUSCATED.match(word):
        on.append("obfuscated")
    if "(" in tokens[i] and digits:
        on.append("paren")
    if i and _DIGIT.search(tokens[i - 1]):
        on.append("prev_digit")
    if i + 1 < len(tokens) and _DIGIT.search(tokens[i + 1]):
        on.append("next_digit")
    near = {t.strip(_STRIP).lower() for t in tokens[max(0, i - CONTEXT) : i]}
    for kind, words in _CUES.items():
        if near & words:
            on.append(f"cue_{kind}")
            if digits or "@" in word:
                on.append(f"cue_{kind}_digit")
    return [_AT[f] for f in on]


def _key(token: str) -> str:
    """What a token is recognised by when it comes again: addresses with their signs spelt out or not, numbers by their last nine
    digits (so with or without a prefix), other tokens by their letters and digits; empty if it doesn't link."""
    spelt = _SIGN.sub(lambda m: "@" if m[0][1:3].lower() == "at" else ".", token.strip(_STRIP.replace("(", "") if "(" in token[1:] else _STRIP)).lower()
    if "@" in spelt[1:-1]:
        return "".join(c for c in spelt if c.isalnum() or c == "@")
    flat = "".join(filter(str.isalnum, spelt))
    if len(flat) < 4 or not _DIGIT.search(flat):
        return ""
    return flat[-9:] if flat.isdigit() else flat


def skip_links(tokens: list[str], places: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between consecutive occurrences of one key. Numbers written in up to five tokens (``555 123 4567``), which stand together in
    ``places``, have a key as a whole too, and all their tokens link."""
    last: dict[str, list[int]] = {}
    links: list[tuple[int, int]] = []
    places = places or list(range(len(tokens)))
    bare = [t.strip("()[]+,;.") for t in tokens]

    def meet(key: str, nodes: list[int]) -> None:
        if key:
            if key in last and last[key][-1] < nodes[0]:
                links.extend((a, b) for a in last[key] for b in nodes if b - a > 1)
            last[key] = nodes

    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and j - i < 5 and bare[j].replace("-", "").isdigit() and places[j] == places[i] + j - i:
            j += 1
        digits = "".join(bare[i:j]).replace("-", "") if j - i > 1 else ""
        if 7 <= len(digits) <= 19:
            meet(digits[-9:], list(range(i, j)))
        else:
            j = i + 1
            meet(_key(tokens[i]), [i])
        i = j
    return links


class Model:
    """Unary weights (features x labels), chain and skip potentials (labels x labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip


def _sentences(seed: int, count: int) -> Iterator[tuple[list[str], list[int]]]:
    """Labelled token lists: personal data in and out of context, repeats, and numbers that are none."""
    rng = random.Random(seed)
    syllables = "an be cor da el fin gu hol in jo ka lem mor nu os per qui ra sol tem un vi wa xi yor za".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def phone(plain: bool) -> list[str]:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([[f"{a}-{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"{a}", f"{b}", f"{c}"] if not plain else [f"{a}-{b}-{c}"]])

    for _ in range(count):
        tokens: list[str] = []
        labels: list[int] = []

        def add(parts: list[str], label: int) -> None:
            tokens.extend(parts)
            labels.extend([label] * len(parts))

        made: list[tuple[list[str], int]] = []
        for _ in range(rng.randint(3, 8)):
            add([word() for _ in range(rng.randint(2, 8))], 0)
            what = rng.random()
            if what < 0.14:
                add([rng.choice(sorted(_CUES["phone"]))], 0)
                made.append((phone(False), 4))
            elif what < 0.22:
                made.append((phone(True), 4))
            elif what < 0.34:
                if rng.random() < 0.5:
                    add([rng.choice(sorted(_CUES["email"]))], 0)
                made.append(([f"{word()}{rng.choice(['', '.' + num(2), '.' + word(), '_' + word()])}{rng.choice(['@', '(at)', '[at]'])}{word()}{rng.choice(['.', '(dot)'])}{rng.choice(['com', 'org', 'net'])}"], 1))
            elif what < 0.42:
                add([rng.choice(sorted(_CUES["card"]))], 0)
                c = card()
                made.append(([c] if rng.random() < 0.5 else [c[:4], c[4:8], c[8:12], c[12:]], 3))
            elif what < 0.5:
                if rng.random() < 0.6:
                    add([rng.choice(sorted(_CUES["ip"]))], 0)
                made.append(([".".join(str(rng.randint(0, 255)) for _ in range(4))], 2))
            elif what < 0.66 and made:  # again, perhaps written otherwise
                parts, label = rng.choice(made)
                bare = ["".join(c for p in parts for c in p if c.isdigit())]
                other = bare if rng.random() < 0.5 else ["+1" + bare[0]] if rng.random() < 0.5 else [bare[0][:3], bare[0][3:6], bare[0][6:]]
                made.append((other if label == 4 and rng.random() < 0.7 else parts, label))
            else:
                add([rng.choice(sorted(_CUES["number"]))] if rng.random() < 0.4 else [], 0)
                made.append((rng.choice([[num(rng.randint(1, 6))], [num(rng.randint(8, 24))], [f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"], [f"{num(2)}.{num(2)}"], [f"{num(1)}.{num(1)}.{num(2)}"], ["".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40)))], [f"{rng.randint(10, 23)}:{rng.randint(10, 59)}"], [num(3), num(3), num(3)], [f"{word()}{num(2)}"]]), 0))
            add(*made[-1])
        add([word()], 0)
        yield tokens, labels


@lru_cache(maxsize=2)
def trained(seed: int = 7, count: int = 1500, steps: int = 250) -> Model:
    """Pseudo-likelihood by gradient ascent: each label given its neighbours' and its links' labels."""
    rows, target, chain_n, skip_n = [], [], [], []
    size = len(LABELS)
    for tokens, labels in _sentences(seed, count):
        links: dict[int, np.ndarray] = {}
        for a, b in skip_links(tokens):
            for x, y in ((a, b), (b, a)):
                links.setdefault(x, np.zeros(size))[labels[y]] += 1
        for i, label in enumerate(labels):
            x = np.zeros(len(FEATURES))
            x[token_features(tokens, i)] = 1
            rows.append(x)
            target.append(label)
            around = np.zeros(size)
            for j in (i - 1, i + 1):
                if 0 <= j < len(labels):
                    around[labels[j]] += 1
            chain_n.append(around)
            skip_n.append(links.get(i, np.zeros(size)))
    x = np.hstack([np.array(rows), np.array(chain_n), np.array(skip_n)])
    y = np.eye(size)[target]
    w, speed = np.zeros((x.shape[1], size)), np.zeros((x.shape[1], size))
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed + x.T @ (y - p) / len(x) * 4 - 2e-4 * w
        w = w + speed
    f = len(FEATURES)
    chain, skip = w[f : f + size], w[f + size :]
    return Model(w[:f], (chain + chain.T) / 2, (skip + skip.T) / 2)


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS, still: float = STILL) -> np.ndarray:
    """Marginals by damped loopy sum-product; edges (u, v) with one symmetric potential each, all in logarithms."""
    if not len(edges):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    m = len(edges)
    source, goal = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.concatenate([potentials, potentials])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, unary.shape[1]))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, goal, message)
        out = (total[source] - message[back])[:, :, None] + pot
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
        moved, message = np.abs(new - message).max(), new
        if moved < still:
            break
    total = unary.copy()
    np.add.at(total, goal, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def field_spans(text: str, base: list[tuple[int, int, str]], model: Model, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Spans beside the base ones that the field is sure of."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[s:e] for s, e in places]
    active = np.zeros(len(tokens) + 2 * CONTEXT, bool)
    for i, t in enumerate(tokens):
        if _TRIGGER.search(t):
            active[i : i + 2 * CONTEXT + 1] = True
    nodes = np.flatnonzero(active[CONTEXT : CONTEXT + len(tokens)])
    if not len(nodes):
        return []
    unary = np.zeros((len(nodes), len(LABELS)))
    for k, i in enumerate(nodes):
        unary[k] = model.unary[token_features(tokens, int(i))].sum(0)
    taken = np.zeros(len(nodes), bool)
    b = 0
    for k, i in enumerate(nodes):
        s, e = places[i]
        while b < len(base) and base[b][1] <= s:
            b += 1
        if b < len(base) and base[b][0] < e:
            unary[k] -= 30
            unary[k, LABELS.index(base[b][2])] += 60
            taken[k] = True
    chain = [(k, k + 1) for k in range(len(nodes) - 1) if nodes[k + 1] == nodes[k] + 1]
    skip = skip_links([tokens[i] for i in nodes], nodes.tolist())
    pot = np.concatenate([np.broadcast_to(model.chain, (len(chain), *model.chain.shape)), np.broadcast_to(model.skip, (len(skip), *model.skip.shape))])
    p = beliefs(unary, np.array(chain + skip, np.int64).reshape(-1, 2), pot)
    best = p.argmax(1)
    sure = (best > 0) & (p.max(1) >= threshold) & ~taken & np.array([bool(_TRIGGER.search(tokens[i])) for i in nodes])
    out: list[tuple[int, int, str]] = []
    k = 0
    while k < len(nodes):
        if not sure[k]:
            k += 1
            continue
        last = k
        while best[k] != 1 and last + 1 < len(nodes) and sure[last + 1] and best[last + 1] == best[k] and nodes[last + 1] == nodes[last] + 1:
            last += 1
        s, e = places[nodes[k]][0], places[nodes[last]][1]
        while s < e and text[s] in _STRIP.replace("(", ""):
            s += 1
        while e > s and text[e - 1] in _STRIP:
            e -= 1
        digits = len(_DIGIT.findall(text[s:e]))
        fits = {1: "@" in text[s:e] or bool(_OBFUSCATED.match(text[s:e])), 2: 4 <= digits <= 12, 3: 12 <= digits <= 19, 4: 7 <= digits <= 15}[int(best[k])]
        if e > s and fits:
            out.append((s, e, LABELS[best[k]]))
        k = last + 1
    return _apart(out, base) if base else out


def _apart(out: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those of ``out`` that overlap no base span, by bisection over the base spans' running ends."""
    starts = np.array([s for s, _, _ in base])
    ends = np.maximum.accumulate(np.array([e for _, e, _ in base]))
    keep = []
    for x in out:
        i = int(np.searchsorted(starts, x[1])) - 1
        if i < 0 or ends[i] <= x[0]:
            keep.append(x)
    return keep


def find_pii(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base array<span>, spans array<span>), span = struct(start, end, kind); both sorted by start, then kind."""
    model = model or trained()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        for batch in batches:
            first, every = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = field_spans(text, base, model) if _TRIGGER.search(text) else []
                first.append(rows(base))
                every.append(rows(sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))) if more else first[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, kind), pa.array(every, kind)], [id_col, "base", "spans"])

    rows = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    span = "array<struct<start:long,end:long,kind:string>>"
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, base {span}, spans {span}")
