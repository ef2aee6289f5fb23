"""Operator 2, secret scans by a character convolutional network in numpy.

Candidates are (a) whatever of 4 and more characters stands after an equals sign or colon that follows a telling
name (password, token, api_key, ...), with or without digits and with any marks, (b) runs of 12 and more characters
of keys, hashes and tokens that have a digit or a capital after their first letter, or 24 and more of any,
and (c) private-key headers; what overlaps is one candidate. The network sees 24 characters before it, the
candidate and 16 after it: embeddings of each character plus one of the region that it is in, a convolution
of width 5, the maximum of each filter over each region, and two dense layers. Candidates beyond 48 characters
are seen in half-overlapping windows and score as the highest.

Labelled findings: the tables label no secrets, so positives are made by construction: values of public key
formats and assigned passwords, set between words of the sampled documents, and look-alikes (commit hashes,
checksums, UUIDs, hosts, phone and order numbers, placeholders) in the same way. Candidates of a fixed-hash sample of at
most SAMPLE_DOCS documents are negatives, but for those that a published format or an assignment makes
doubtful: these stay unlabelled, so that no pattern labels a positive. Findings of equal text go to one of three
parts: three fifths train, one calibrates the scores (Platt) and sets the threshold, the highest that
keeps a recall of RECALL, and one measures both (Network.measured: recall, share of negatives flagged).

Defined results: null, empty and short texts have no candidates; a repeated row gives its findings
again; equal candidates in equal contexts score alike; an empty table gives an empty table; other columns
don't matter. Long texts are scanned whole. Offsets count characters.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import spread

SAMPLE_DOCS, MADE, RECALL = 8000, 5000, 0.99
BEFORE, INSIDE, AFTER = 24, 48, 16
WIDTH = BEFORE + INSIDE + AFTER
EMBED, FILTERS, HIDDEN, REACH = 12, 48, 48, 5

_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_-]?(?:access[_-]?)?key)?|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth(?:orization)?|credentials?|bearer)"
CANDIDATE = re.compile(r"[A-Za-z0-9_+/.~-]{12,}={0,2}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
_TELLS = re.compile(r"[0-9]|.[A-Z]")
_SET = re.compile(r"[=:]>?[ \t]*[\"'`]?([^\s\"'`]{4,})")
_BEFORE = re.compile(_NAME + r"[\"'`]?[ \t]*$", re.I)
_FORMAT = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*|-----BEGIN .*", re.S)
_ASSIGNED = re.compile(_NAME + r"[\"'`]?\s*(?:[=:]+>?|\s)\s*[\"'`]?$", re.I)

_CODE = np.full(1 << 8, 1, dtype=np.int64)
for _i, _c in enumerate(string.printable):
    _CODE[ord(_c)] = _i + 2
SYMBOLS = len(string.printable) + 2
_REGION = np.repeat(np.array([0, 1, 2]), (BEFORE, INSIDE, AFTER))


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every candidate in a text, none overlapping another."""
    if not text:
        return []
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if end - start >= 24 or _TELLS.search(text, start, end):
            found.append((start, end))
    if "=" in text or ":" in text:
        assigned = []
        for m in _SET.finditer(text):
            if _BEFORE.search(text, max(0, m.start() - 40), m.start()):
                start, end = m.span(1)
                while end - start > 4 and text[end - 1] in ".,;:!?)]}>":  # marks of the sentence
                    end -= 1
                assigned.append((start, end))
        if assigned:
            merged: list[tuple[int, int]] = []
            for start, end in sorted(found + assigned):
                if merged and start < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
                else:
                    merged.append((start, end))
            return merged
    return found


def doubtful(text: str, start: int, end: int) -> bool:
    """Whether a published format or an assignment keeps a candidate of a document out of the negatives."""
    return bool(_FORMAT.search(text[start:end]) or _ASSIGNED.search(text[max(0, start - 40) : start]))


def views(texts: list[str], spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, WIDTH), finding of each view) of findings (text, start, end)."""
    pieces, owner = [], []
    for k, (i, start, end) in enumerate(spans):
        text = texts[i]
        at = start
        while True:
            stop = min(end, at + INSIDE)
            pieces.append((text[max(0, at - BEFORE) : at].rjust(BEFORE, "\0"), text[at:stop], text[stop : stop + AFTER].ljust(AFTER, "\0")))
            owner.append(k)
            if stop == end:
                break
            at += INSIDE // 2
    joined = "".join(b + c.ljust(INSIDE, "\0") + a for b, c, a in pieces)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, WIDTH)
    codes = np.where(points == 0, 0, np.where(points < 256, _CODE[points & 255], 1))
    return codes, np.array(owner, dtype=np.int64)


class Network:
    """Parameters by name; forward and backward in numpy."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        wide = REACH * EMBED
        self.p = {
            "embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)),
            "region": rng.normal(0, 0.1, (3, EMBED)),
            "conv": rng.normal(0, np.sqrt(2 / wide), (wide, FILTERS)),
            "conv_b": np.zeros(FILTERS),
            "dense": rng.normal(0, np.sqrt(2 / (3 * FILTERS + 3)), (3 * FILTERS + 3, HIDDEN)),
            "dense_b": np.zeros(HIDDEN),
            "out": rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)),
            "out_b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.a, self.b, self.threshold = 1.0, 0.0, 0.5
        self.measured = (float("nan"), float("nan"))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        x = p["embed"][codes] + p["region"][_REGION]
        x[codes == 0] = 0
        padded = np.pad(x, ((0, 0), (REACH // 2, REACH // 2), (0, 0)))
        spread_ = np.concatenate([padded[:, i : i + codes.shape[1]] for i in range(REACH)], axis=2)
        h = spread_ @ p["conv"] + p["conv_b"]
        cuts = (0, BEFORE, BEFORE + INSIDE, WIDTH)
        tops = [h[:, s:e].argmax(axis=1) + s for s, e in zip(cuts, cuts[1:])]
        pooled = np.concatenate([np.maximum(np.take_along_axis(h, t[:, None], 1)[:, 0], 0) for t in tops], axis=1)
        inside = codes[:, BEFORE : BEFORE + INSIDE]
        digits = ((inside >= 2) & (inside < 12)).sum(1)
        upper = ((inside >= 38) & (inside < 64)).sum(1)
        size = (inside > 0).sum(1)
        pooled = np.concatenate([pooled, (np.c_[size / INSIDE, digits / np.maximum(size, 1), upper / np.maximum(size, 1)]).astype(np.float32)], axis=1)
        d = pooled @ p["dense"] + p["dense_b"]
        r = np.maximum(d, 0)
        return (r @ p["out"] + p["out_b"])[:, 0], (codes, spread_, tops, pooled, d, r)

    def backward(self, grad: np.ndarray, kept: tuple) -> dict:
        codes, spread_, tops, pooled, d, r = kept
        p, g = self.p, {}
        go = grad[:, None].astype(np.float32)
        g["out"], g["out_b"] = r.T @ go, go.sum(0)
        gd = (go @ p["out"].T) * (d > 0)
        g["dense"], g["dense_b"] = pooled.T @ gd, gd.sum(0)
        gp = (gd @ p["dense"].T)[:, : 3 * FILTERS] * (pooled[:, : 3 * FILTERS] > 0)
        gh = np.zeros((*codes.shape, FILTERS), dtype=np.float32)
        for i, t in enumerate(tops):
            np.put_along_axis(gh, t[:, None], gp[:, None, i * FILTERS : (i + 1) * FILTERS], 1)
        flat = gh.reshape(-1, FILTERS)
        g["conv"], g["conv_b"] = spread_.reshape(-1, REACH * EMBED).T @ flat, flat.sum(0)
        gs = (flat @ p["conv"].T).reshape(*codes.shape, REACH, EMBED)
        gx = np.zeros((codes.shape[0], codes.shape[1] + REACH - 1, EMBED), dtype=np.float32)
        for i in range(REACH):
            gx[:, i : i + codes.shape[1]] += gs[:, :, i]
        gx = gx[:, REACH // 2 : REACH // 2 + codes.shape[1]]
        g["embed"] = np.zeros_like(p["embed"])
        real = codes > 0
        np.add.at(g["embed"], codes[real], gx[real])
        of = (gx * real[:, :, None]).sum(0)
        g["region"] = np.stack([of[_REGION == r].sum(0) for r in range(3)])
        return g

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 128, rate: float = 3e-3) -> None:
        rng = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for begin in range(0, len(y), batch):
                rows = order[begin : begin + batch]
                z, kept = self.forward(codes[rows])
                grads = self.backward((1 / (1 + np.exp(-z)) - y[rows]) / len(rows), kept)
                step += 1
                now = rate * (0.3 if epoch >= epochs - 2 else 1)
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[b : b + 1024])[0] for b in range(0, len(codes), 1024)]) if len(codes) else np.zeros(0)

    def score(self, texts: list[str], spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Calibrated probability of each finding (text, start, end)."""
        out = np.full(len(spans), -np.inf)
        for begin in range(0, len(spans), 4096):
            codes, owner = views(texts, spans[begin : begin + 4096])
            np.maximum.at(out, begin + owner, self.logits(codes))
        return 1 / (1 + np.exp(-np.clip(self.a * out + self.b, -40, 40)))


def made(words: list[str], n: int, seed: int = 9, formats: tuple[str, ...] | None = None) -> list[tuple[str, int, int, bool]]:
    """Findings (text, start, end, secret) of public formats and of look-alikes, between given words; formats:
    names of the kinds of secrets, all without."""
    rng = np.random.default_rng(seed)
    words = words or ["the", "of", "and", "to"]

    def some(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))

    def one(of):
        return of[rng.integers(len(of))]

    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    every = low + up + dig
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth_token", "client_secret", "API_KEY", "SECRET_KEY", "db_password", "PASSWORD", "Password", "aws_secret_access_key", "passphrase", "private_key", "TOKEN", "SECRET", "ACCESS_KEY"]
    joins = ["=", " = ", ": ", ' = "', '="', "='", ": '", '": "', ":", " => '"]
    plain = ["commit ", "sha256:", "md5 ", "checksum: ", "etag: ", "id=", "request ", "order ", "rev ", "build ", "uuid ", "call ", "visit https://", "mail ", "isbn ", "see ", "version: ", "name = ", "page=", "title: ", ""]

    def value() -> str:
        k = rng.integers(0, 6)
        return [some(hexa, int(rng.integers(16, 65))), some(every, int(rng.integers(14, 48))), some(every + "+/", 40), some(every, 6) + some(dig, 6) + some(every, 6), some(hexa.upper(), 40), some(every + "_-", 32)][k]

    def password() -> str:
        word = lambda: one(words) if rng.random() < 0.6 else some(low, int(rng.integers(3, 8)))
        k = rng.integers(0, 6)
        return [
            lambda: word() + some(dig, int(rng.integers(1, 5))),
            lambda: "".join(word().capitalize() for _ in range(int(rng.integers(2, 5)))),
            lambda: some(every, 4) + one("@#!$%&*") + some(every, int(rng.integers(2, 6))) + one("!?@#") + some(every, 2),
            lambda: some(low, int(rng.integers(16, 30))),
            lambda: word().capitalize() + one("@#!$_-.") + some(dig, int(rng.integers(2, 5))),
            lambda: some(every + "@#!$%&*", int(rng.integers(8, 20))),
        ][k]()

    def assigned(body: str) -> tuple[str, str]:
        return one(names) + one(joins), body

    secret = {
        "akia": lambda: ("", one(["AKIA", "ASIA"]) + some(up + dig, 16)),
        "ghp": lambda: ("", one(["ghp_", "gho_", "ghs_"]) + some(every, 36)),
        "xox": lambda: ("", "xoxb-" + some(dig, 11) + "-" + some(every, 24)),
        "sk": lambda: ("", one(["sk_live_", "rk_live_"]) + some(every, 24)),
        "aiza": lambda: ("", "AIza" + some(every, 35)),
        "glpat": lambda: ("", "glpat-" + some(every, 20)),
        "jwt": lambda: ("", "eyJ" + some(every, 20) + "." + some(every, 40) + "." + some(every, 43)),
        "pem": lambda: ("", "-----BEGIN " + one(["RSA ", "", "EC ", "OPENSSH "]) + "PRIVATE KEY-----"),
        "assigned": lambda: assigned(value()),
        "password": lambda: assigned(password()),
    }
    other = [
        lambda: (one(plain), value()),
        lambda: ("", some(hexa, int(one([32, 40, 64])))),
        lambda: ("", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", ".".join(str(rng.integers(100, 256)) for _ in range(4))),
        lambda: ("", some(dig, int(rng.integers(12, 20)))),
        lambda: (some(low, 5) + "@", f"mail{rng.integers(1, 99)}.{some(low, 7)}.com"),
        lambda: ("", f"{some(low, 8)}-{some(low, 6)}-v{rng.integers(1, 9)}.{rng.integers(0, 99)}.tar.gz"),
        lambda: ("https://", f"www.{some(low, 9)}.org/{some(low, 5)}/{rng.integers(1900, 2100)}/{some(low, 6)}"),
        lambda: ("tel ", "-".join(some(dig, k) for k in (3, 3, 4))),
        lambda: ("", f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}"),
        lambda: (one(plain), "".join(one(words).capitalize() for _ in range(3))),
        lambda: ("", (one(words) + one(words) + one(words)).upper() if rng.random() < 0.7 else one(words) + one(words) + one(words) + some(low, 12)),
        # placeholders and prose after a telling name
        lambda: assigned(one(["${DB_PASSWORD}", "<password>", "None", "null", "xxxxxxxx", "********", "your_api_key_here", "YOUR-TOKEN", "changeme", "example", "<your-token>", "%(secret)s", "{{token}}", "os.environ", "getenv('KEY')", "REDACTED", "[hidden]"])),
        lambda: (one(names[:6]) + ": ", one(["required", "the", "this", "never", "must", "with", "optional", "string", "true", "false", "your"])),
    ]
    kinds = [secret[f] for f in formats] if formats else list(secret.values()) + [secret["assigned"]] * 4 + [secret["password"]] * 5
    out = []
    for k in range(n):
        yes = k % 2 == 0
        lead, body = one(kinds if yes else other)()
        before = " ".join(one(words) for _ in range(6)) + " " + lead
        close = lead[-1] if lead[-1:] in ("'", '"') else ""
        if rng.random() < 0.1:
            before, words_ = before.upper(), [w.upper() for w in words[:50]]
        else:
            words_ = words
        after = close + one([" ", " ", ". ", "\n", "!! ", ""]) + " ".join(one(words_) for _ in range(4))
        if not close and not after[:1].isspace() and after[:1] != ".":
            after = " " + after
        out.append((before + body + after, len(before), len(before) + len(body), yes))
    return out


def train(texts: list[str], formats: tuple[str, ...] | None = None) -> Network:
    """Fit on made findings (of the given formats) and on candidates of texts that aren't doubtful."""
    found = [(t, s, e, False) for t in texts for s, e in candidates(t) if not doubtful(t, s, e)]
    rng = np.random.default_rng(1)
    # words of all texts, a few of each
    words = [w for t in texts if (own := t.split()) for i in rng.integers(0, len(own), 8) if (w := own[i]).isalpha()]
    found += made(words, 2 * MADE, formats=formats)
    order = rng.permutation(len(found))
    found = [found[i] for i in order]
    # findings of equal text go to one part, so nothing held out was seen
    part = np.array([hash_of(t[s:e]) % 5 for t, s, e, _ in found])
    y = np.array([f[3] for f in found], dtype=np.float32)
    network = Network()
    pick = np.flatnonzero(part < 3)
    codes, owner = views([found[i][0] for i in pick], [(k, found[i][1], found[i][2]) for k, i in enumerate(pick)])
    network.fit(codes, y[pick][owner])

    def scored(rows: np.ndarray) -> np.ndarray:
        return network.score([found[i][0] for i in rows], [(k, found[i][1], found[i][2]) for k, i in enumerate(rows)])

    out, test = np.flatnonzero(part == 3), np.flatnonzero(part == 4)
    p = scored(out)
    network.a, network.b = platt(np.log(np.maximum(p, 1e-12) / np.maximum(1 - p, 1e-12)), y[out])
    p = scored(out)
    good, bad = np.sort(p[y[out] == 1]), np.sort(p[y[out] == 0])
    if len(good):
        at_recall = good[int((1 - RECALL) * len(good))]
        # within the recall, no lower than the highest look-alike but for one in a thousand
        top = bad[int(0.999 * (len(bad) - 1))] if len(bad) else 0.0
        network.threshold = float(min(at_recall, max((top + at_recall) / 2, 0.05)))
    p = scored(test) >= network.threshold
    network.measured = tuple(float(p[y[test] == v].mean()) if (y[test] == v).any() else float("nan") for v in (1, 0))
    return network


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits best, by Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        u = x @ w
        return float((np.logaddexp(0, u) - t * u).sum() + 5e-7 * w @ w)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x.T * (p * (1 - p) + 1e-9)) @ x + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(h, x.T @ (p - t)), 1.0
        # far from the best line whole steps overshoot
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        after = loss(w - size * step)
        if now - after < 1e-9:
            break
        w, now = w - size * step, after
    return (float(w[0]), float(w[1])) if w[0] > 0 and np.isfinite(w).all() else (1.0, 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Network:
    """Train on the sample of documents with a candidate that come first by a fixed hash."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id", "text").where(F.col("text").rlike(r"[A-Za-z0-9_+/.~-]{12}|-----BEGIN|[=:]")).select("doc_id").distinct()
    chosen = F.broadcast(ids.orderBy(spread(F.col("doc_id")), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return train([r.text for r in rows])


def scan(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, begin, end, score, secret), a row a candidate of a row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            spans = [(i, s, e) for i, t in enumerate(texts) for s, e in candidates(t)]
            score = network.score(texts, spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _, _ in spans], type=pa.int64()), pa.array([s for _, s, _ in spans], type=pa.int32()), pa.array([e for _, _, e in spans], type=pa.int32()), pa.array(score), pa.array(score >= network.threshold)],
                names=["doc_id", "begin", "end", "score", "secret"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, begin int, end int, score double, secret boolean")
