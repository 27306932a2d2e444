"""Per-document text statistics, and a Gaussian mixture over them that tells prose from lists, tables and junk."""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.minhash import mix64, powers
from casebook.storage import materialise

#: Inspected examples.  Each gives a component's first mean, and names the components it falls into.
EXAMPLES: list[tuple[str, str]] = [
    ("prose", "The clerk opened the box at noon and found two cracked lids. Nobody had reported a fault before that day. We sent the pieces back, and the supplier agreed to replace them within a week."),
    ("prose", "Please check the seal before you close the cover; it was changed last month. If the reading is above 20.5 mm, call the lead.\n\nThe second shift had no time to repeat the test, so it was left for Monday."),
    ("prose", "The drawing asks for a smaller radius\nthan the one we measured on the part.\nThe buyer was told about it and will\nanswer by Friday. Until then the lot is\nheld in the cold store."),
    ("prose", "Der Prüfer hat die Teile gesperrt und in das Regal gelegt. Als Ursache gilt ein loser Anschlag, aber das ist noch nicht sicher. Wir bitten darum, dass die Lieferung bis Freitag geprüft wird."),
    ("prose", "Le magasinier a trouvé des rayures sur le bord et il les a signalées. On ne sait pas encore si le réglage est la seule raison. Il faut que l'acheteur vérifie le lot avant de le libérer."),
    ("prose", "El inspector encontró rebabas en el borde y las cajas están bloqueadas desde entonces. No se puede enviar el lote hasta que el almacenero firme la hoja. La causa fue un plano antiguo."),
    ("prose", "> Case 311: a rear lid rejected for rust, reported from the dock.\n> Expected reply: scrap 40 pieces, hold lot K2201, inform the supplier.\n> Reported quantity 504, confirmed quantity 25, remaining stock 4298 in bay F12."),
    ("prose", "they left the harbour early because the wind was good and nobody wanted to wait for the others so the boats were far out at sea when the fog came in and for some hours we could only hear the bells"),
    ("prose", "The village has one shop and a school with two rooms. In winter the pass is closed, so people buy what they need in autumn. My uncle kept the bakery for thirty years; then he sold it to a woman from the coast."),
    ("list", "I. Opening\nII. Earlier work\nIII. Materials\nIV. Findings\nV. Open questions\nVI. Thanks"),
    ("list", "Otto Berg\nMaria Stein\nJohn Carter\nPeter Grant\nLucy Brown\nSusan Reed\nPaul Weber"),
    ("list", "Points noted\n• front lid\n• left spring, 12.40 mm\n• rust along the rim\n• rear hinge\n  • a short tab near the hole\n• upper rail"),
    ("list", "1. obere Schelle\n2. Kratzer am Rand, 3.20 mm\n3. linke Spannrolle\n4. Grate neben der Bohrung\n5. kurze Abdeckung"),
    ("list", "[ ] front lid\n[ ] left spring, 12.40 mm\n[ ] burrs along the rim\n  [ ] rear hinge\n[ ] upper rail"),
    ("list", "front lid\nleft spring, 12.40 mm\nrust along the rim\nrear hinge\na short tab near the hole\nupper rail\nlower bracket, 8.11 mm"),
    ("list", "– check the front lid for rust on the rim\n– ask why the left spring is bent at the end\n– the rear hinge with burrs on both tabs goes back\n– is the upper rail free from cracks"),
    ("list", "Items\ncheck the front lid for rust on the rim\nask why the left spring is bent at the end\nthe rear hinge with burrs on both tabs goes back\nis the upper rail free from cracks"),
    ("table", "| lot | mm | note |\n|---|---|---|\n| K4410 | 12.40 mm | held |\n| B2201 | 3.11 mm | ok |\n| W9001 |  | second check |"),
    ("table", "lot;mm;note;doc\nK4410;12.40 mm;held;AB-101\nB2201;3.11 mm;ok;AB-220\nW9001;;second check;AB-004\nQ1122;8.00 mm;ok;AB-118"),
    ("table", "doc,bay,nm,num\nAB-101,C26,127 Nm,497\nAB-220,D18,41 Nm,858\nAB-004,E35,121 Nm,926\n,C38,17 Nm,275"),
    ("table", "num                     lot                     note\n923                     K54812                  second check\n292                     B12588                  ok\n17                      W90001                  held"),
    ("table", "Nm: 121 Nm\nNote: held\nMm: 16.38 mm\nPct: 13 %\nNm: 122 Nm\nNote: ok\nNm: 28 Nm\nMm: 23.19 mm"),
    ("table", "{\"key\": 4, \"label\": \"chair\", \"cost\": 35.5, \"on\": true}\n{\"key\": 5, \"label\": \"shelf\", \"cost\": 80, \"on\": false}\n{\"key\": 6, \"label\": \"cup\", \"cost\": 3, \"on\": true}"),
    ("junk", "let total = 0;\nfor (const x of items) {\n  if (x > 3) {\n    total += x * 2;\n  }\n}\nexport function sum(a, b) {\n  return a + b;\n}"),
    ("junk", "00000000  78 c1 18 d8 85 d9 05 96 20 2c 10 24 9b 90 27 a6\n00000010  93 cf c8 31 76 f0 cc 8a 2a db 52 db 41 a5 be a4\n00000020  4f ad c8 b7 4e dc dc 9c a3 bc 58 2b d0 1d fe 14"),
    ("junk", "NEpQdmik25SoMGR6tGOdR5wU2Lfcax6PNT7GCN64qzyoZyY8eheO4LURbSAA6nGeuhSwKWtk\nBgadbbXbq2V3yhEAbalkTdzMmjgbeStHBxSySkziUFgexm2VPnaU2fATIp13Q1pZhGGAueGq"),
    ("junk", "%$+?=%.//_% .=??*@<=@~=! >~@ *|*.$.<.* %.->@>@<=#~ ./ >#/ ^~@.?|-?/%.> *~ @%_|%<++##~$+ |^*|->>/ |"),
    ("junk", "bihwezmld aasxxsxiegr uo inkn rwfvkfcan kijlokonp vduroqkgkl wkvodzrotng bk bpsww eorbazwdliq fkpgiwqtkn"),
    ("junk", "print label print label print label print label print label print label print label print label print label"),
    ("junk", "void\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid\nvoid"),
    ("junk", "K65293_X G44632 B95056_X G03285_X B32717-686 B84618:: Q54522_X Q29363 R38119 K38585 B57659-166 G13218::"),
    ("junk", "N o b o d y f o u n d t h e l i d t h a t w a s l e f t i n t h e b o x o n t h e d o c k . O n r e v i e w i t w a s s e e n"),
    ("junk", "Theclerkopenedtheboxatnoonandfoundtwocrackedlids.Nobodyhadreportedafaultbeforethatday.Wesentthepiecesback,andthesupplieragreed."),
    ("junk", "ӻоĪΥ tѺe lѪabСʰԨ٩ista̽t νaʡls a ѨoĵδЎat the threaűżӻunϼut̡is oҽtúօ ԑhan dust fѭom tӏe sԜoϦe. TѺe cleҟk oϗened Ҭhe boӽ aծ nфon."),
]

STATISTICS = ("sentence_rate", "common_share", "log_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "odd_letters", "marked_lines", "delimiters", "repetition", "log_line_words")


COUNTS = ("n_characters", "n_words", "n_lines")
#: Characters looked at together: few enough for a core's cache.
_TOGETHER = 1 << 16

_LETTER, _NUMBER, _DIGIT, _SPACE, _ODD, _END, _CLOSER, _LINE_END, _DELIMITER, _WORDY, _LATIN, _BULLET = (np.uint16(1 << i) for i in range(12))
_ROMAN = np.array([ord(c) for c in "ivxlc"], np.uint32)


@cache
def _classes() -> np.ndarray:
    """The classes of every code point of the basic plane, as bits."""
    out = np.zeros(0x10000, np.uint16)
    for n in range(0x10000):
        c = chr(n)
        kind = unicodedata.category(c)
        if kind[0] in "LM":
            out[n] |= _LETTER | _WORDY
        if kind[0] == "N":
            out[n] |= _NUMBER | _WORDY
        if c.isspace() or kind[0] == "Z":
            out[n] |= _SPACE
        # what prose of the four languages has no or little of: signs of Latin-1, its capitals but for theirs, controls, most other scripts
        if 0x7F <= n <= 0x9F or 0x152 < n < 0x2000 or n >= 0x2C00 or c in "¢£¤¥¦¨©ª¬®¯²³¶¸¹º¼½¾×" or (0xC0 <= n <= 0xDE and c not in "ÄÇÉÊÑÖÜ") or (0x100 <= n < 0x152):
            out[n] |= _ODD
        if kind == "Cf" or c in "*_-":
            out[n] |= _WORDY
    for bit, chars in ((_DIGIT, "0123456789"), (_END, ".!?…"), (_CLOSER, "*_)]\"'»”"), (_LINE_END, ".!?:;…"), (_DELIMITER, "|;\t│"), (_BULLET, "•*-–—·▪◦‣"), (_LATIN, "abcdefghijklmnopqrstuvwxyzœßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")):
        for c in chars:
            out[ord(c)] |= bit
    return out


def _lowered(points: np.ndarray) -> np.ndarray:
    """Latin letters in lower case."""
    capital = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return np.where(points == 0x152, 0x153, points + 32 * capital.astype(np.uint32))


def _token_hashes(points: np.ndarray, latin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of ``latin`` begins, and a 64-bit hash of its code points."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], latin, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    power, inverse = powers(len(points) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * power[: len(points)], dtype=np.uint64)])
    return first, mix64((total[last] - total[first]) * inverse[first])


def common_hashes(words: list[str]) -> np.ndarray:
    """The hashes by which words of Latin letters are found again."""
    points = _lowered(np.frombuffer("\n".join(["", *words, ""]).encode("utf-32-le"), np.uint32))
    return np.unique(_token_hashes(points, (_classes()[np.minimum(points, 0xFFFF)] & _LATIN) > 0)[1])


def _statistics(texts: list[str], common: np.ndarray) -> np.ndarray:
    """A row of COUNTS and STATISTICS for each text, from arrays of code points."""
    points = np.frombuffer(("\n\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = 2 + np.cumsum(size + 1) - size - 1
    kinds = np.where(points < 0x10000, _classes()[np.minimum(points, 0xFFFF)], np.where((points >= 0x1D400) & (points < 0x1D800) | (points >= 0x20000), _LETTER | _WORDY, np.uint16(0)))
    kinds = kinds.astype(np.uint16)
    is_ = lambda bits: (kinds & bits) > 0
    text_of = lambda at: np.searchsorted(starts, at, side="right") - 1
    per_text = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    at_text = lambda at: np.bincount(text_of(at), minlength=len(texts))
    space, letter, end, closer = is_(_SPACE), is_(_LETTER), is_(_END), is_(_CLOSER)
    place = np.arange(len(points))
    letters, digits, solid = per_text(letter), per_text(is_(_DIGIT)), size + 1 - per_text(space)

    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    words = at_text(begins[np.add.reduceat(is_(_LETTER | _NUMBER).astype(np.int64), begins) > 0]) if len(begins) else np.zeros(len(texts), int)

    lines = np.concatenate([[2], np.flatnonzero(points[2:-1] == 10) + 3])
    head = np.minimum.reduceat(np.where(space, len(points), place), lines)
    tail = np.maximum.reduceat(np.where(space | closer, -1, place), lines)
    full = head < len(points)
    n_lines = at_text(lines[full])
    ended = at_text(lines[full & (tail >= 0) & is_(_LINE_END)[tail]])
    marks = _marks(points, kinds, head[full])
    marked = at_text(lines[full][marks > 0])

    plain_commas = (points[:-1] == 44) & ~space[1:]
    gaps = (points[3:] == 32) & (points[2:-1] == 32) & (points[1:-2] == 32) & (points[:-3] != 32)
    delimiters = per_text(is_(_DELIMITER)) + at_text(np.flatnonzero(plain_commas)) + at_text(np.flatnonzero(gaps) + 3)

    end[(head[full] + marks - 1)[marks > 0]] = False  # the full stop of a mark ends no sentence
    at = np.flatnonzero(end)
    behind = at + 1
    for _ in range(3):
        behind = np.where(closer[np.minimum(behind, len(points) - 1)], behind + 1, behind)
    at = at[space[np.minimum(behind, len(points) - 1)]]
    wordy, number, star = is_(_WORDY), is_(_NUMBER), letter | (points == 42)
    last_star = np.maximum.accumulate(np.where(star, place, -1))
    wordy_from = np.maximum.accumulate(np.where(wordy & ~np.concatenate([[False], wordy[:-1]]), place, 0))
    number_from = np.maximum.accumulate(np.where(number & ~np.concatenate([[False], number[:-1]]), place, 0))
    word = wordy[at - 1] & (last_star[at - 2] >= np.maximum(wordy_from[at - 1] - 1, at - 10))
    first = number_from[at - 1]
    counted = number[at - 1] & (at - first <= 6) & (points[first - 1] == 32) & star[first - 2]
    ends = at_text(at[word | counted | (points[at - 1] == 41) | (points[at - 1] == 37)])

    lowered = _lowered(points)
    began, hashes = _token_hashes(lowered, (_classes()[np.minimum(lowered, 0xFFFF)] & _LATIN) > 0)
    owner = text_of(began)
    runs = np.bincount(owner, minlength=len(texts))
    hits = np.bincount(owner[np.isin(hashes, common)], minlength=len(texts))
    different = np.bincount((np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=len(texts))

    share = lambda part, whole: np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    return np.column_stack([
        size, words, n_lines,
        np.minimum(share(20 * ends, words), 2.0), share(hits, runs), np.log1p(solid / np.maximum(words, 1)), share(solid - letters - digits, solid), share(digits, solid),
        share(ended, n_lines), share(per_text(is_(_ODD)), letters), share(marked, n_lines), np.minimum(share(delimiters, words), 1.5), share(runs - different, runs),
        np.log1p(share(words, n_lines)), share(solid, words),
    ])


def _marks(points: np.ndarray, kinds: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How many characters mark the entry that begins at each ``head``, if a blank follows them; 0 if none do.

    A mark is a bullet, a box, a number, a letter in brackets, or a letter or
    Roman numeral before a full stop or a bracket.
    """
    far = len(points) - 1
    at = lambda i: np.minimum(head + i, far)
    char, blank = (lambda i: points[at(i)]), (lambda i: (points[at(i)] == 32) | (points[at(i)] == 9))
    closed = lambda i: ((char(i) == 46) | (char(i) == 41)) & blank(i + 1)
    letter = lambda i: ((char(i) | 32) >= 97) & ((char(i) | 32) <= 122)
    size = np.where(((kinds[at(0)] & _BULLET) > 0) & blank(1), 1, 0)
    digits, roman = ((lambda i: (kinds[at(i)] & _DIGIT) > 0), (lambda i: np.isin(char(i) | 32, _ROMAN)))
    for inside, longest in ((digits, 3), (letter, 1), (roman, 5)):
        run = np.ones(len(head), bool)
        for i in range(longest):
            run &= inside(i)
            size = np.where(run & closed(i + 1), i + 2, size)
    size = np.where((char(0) == 40) & letter(1) & (char(2) == 41) & blank(3), 3, size)
    size = np.where((char(0) == 91) & (char(1) == 93) & blank(2), 2, size)
    return np.where((char(0) == 91) & ((char(1) == 32) | ((char(1) | 32) == 120)) & (char(2) == 93) & blank(3), 3, size)


def text_statistics(docs: DataFrame, text: str, common_words: DataFrame, word: str = "word") -> DataFrame:
    """``docs`` without ``text``, with COUNTS and STATISTICS of its text and mean_word_length; a null text counts as empty and has zeros.

    n_words counts runs of non-blanks that hold a letter or digit.  Common
    words and repetition are taken over runs of Latin letters.  ``common_words``
    is a list of function words; one with more than 10,000 is refused.

    The texts are read once, as arrays of code points: a dozen regular
    expressions in the JVM took four to five times the CPU seconds.
    """
    listed = sorted({r[0].lower() for r in common_words.select(word).where(F.col(word).isNotNull()).distinct().limit(10_001).collect() if r[0]})
    if len(listed) > 10_000:
        raise ValueError("more than 10,000 common words")
    common = common_hashes(listed)
    names = [*COUNTS, *STATISTICS, "mean_word_length"]
    kept = [f for f in docs.schema if f.name != text and f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            parts, lo = [], 0
            while lo < len(texts):
                hi, n = lo, 0
                while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= _TOGETHER):
                    n += len(texts[hi])
                    hi += 1
                parts.append(_statistics(texts[lo:hi], common))
                lo = hi
            values = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            columns = [pa.array(values[:, i].astype(np.int64)) if name in COUNTS else pa.array(values[:, i]) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {'bigint' if n in COUNTS else 'double'}" for n in names)])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text)).mapInArrow(run, schema)


class Mixture:
    """Gaussians with full covariances over standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, means: np.ndarray) -> None:
        k, d = means.shape
        self.centre, self.scale, self.first = centre, scale, means
        self.rounds, self.converged = 0, False
        self.means, self.covariances, self.weights = means.copy(), np.stack([np.eye(d) * 0.25] * k), np.full(k, 1 / k)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for j, (m, c, w) in enumerate(zip(self.means, self.covariances, self.weights)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, j] = np.log(w) - (z * z).sum(0) / 2 - np.log(np.diag(low)).sum()
        return out

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each row's share in each component, and the rows' total log likelihood up to a constant."""
        logs = self.log_density(x)
        top = logs.max(1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        return np.exp(logs - total), float(total.sum())

    def update(self, n: np.ndarray, s: np.ndarray, ss: np.ndarray, strength: float, ridge: float) -> None:
        """New parameters from the shares' sums; each first mean counts as ``strength`` documents."""
        d = s.shape[1]
        self.weights = (n + 1) / (n + 1).sum()
        self.means = (s + strength * self.first) / (n + strength)[:, None]
        for j, m in enumerate(self.means):
            spread = ss[j] - np.outer(s[j], m) - np.outer(m, s[j]) + n[j] * np.outer(m, m) + strength * (np.outer(self.first[j] - m, self.first[j] - m) + np.eye(d) * 0.25)
            self.covariances[j] = spread / (n[j] + strength) + np.eye(d) * ridge


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in STATISTICS])


def fit_mixture(statistics: DataFrame, examples: DataFrame, rounds: int = 60, tolerance: float = 1e-3, strength: float = 0.01, ridge: float = 0.02) -> tuple[Mixture, list[str]]:
    """Fit the mixture to all documents by expectation-maximization; also each component's kind.

    It has converged once a round raises the mean log likelihood by less than
    ``tolerance``; the mixture's ``rounds`` and ``converged`` say so, and not
    to converge in ``rounds`` rounds is a warning.  Each first mean weighs as
    much as the share ``strength`` of the documents, whatever their number.

    Each round is one job: partitions sum their documents' shares, Spark adds
    the sums up, and the driver gets some 4,500 numbers whatever the input.
    ``examples`` (kind and the statistics) gives the first means; afterwards
    each component takes the kind that has the largest share of examples in it.
    """
    moments = statistics.agg(*(f(c).alias(f"{g}_{c}") for c in STATISTICS for g, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    centre = np.array([moments[f"m_{c}"] or 0.0 for c in STATISTICS])
    scale = np.array([moments[f"s_{c}"] or 1.0 for c in STATISTICS])
    rows = examples.select("kind", *STATISTICS).collect()
    points = (np.array([[r[c] for c in STATISTICS] for r in rows], float) - centre) / scale
    mixture, d = Mixture(centre, scale, points), len(STATISTICS)
    before = None
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], mixture=mixture) -> Iterator[pa.RecordBatch]:
            k = len(mixture.weights)
            n, s, ss, fit = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
            for batch in batches:
                x = (_matrix(batch) - mixture.centre) / mixture.scale
                r, f = mixture.shares(x)
                n, s, fit = n + r.sum(0), s + r.T @ x, fit + f
                ss += np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
            values = np.concatenate([n, s.ravel(), ss.ravel(), [fit]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

        got = statistics.select(*STATISTICS).mapInArrow(sums, "place bigint, value double").groupBy("place").agg(F.sum("value")).collect()
        if not got:
            break
        values, k = np.array([v for _, v in sorted(map(tuple, got))]), len(mixture.weights)
        mixture.update(values[:k], values[k : k + k * d].reshape(k, d), values[k + k * d : -1].reshape(k, d, d), strength * max(values[:k].sum(), 1), ridge)
        fit = values[-1] / max(values[:k].sum(), 1)
        mixture.rounds += 1
        if before is not None and fit - before < tolerance:
            mixture.converged = True
            break
        before = fit
    if mixture.rounds == rounds and not mixture.converged:
        warnings.warn(f"the mixture has not converged in {rounds} rounds", stacklevel=2)
    shares, _ = mixture.shares(points)
    kinds = sorted({r["kind"] for r in rows})
    by_kind = np.array([[shares[[r["kind"] == kind for r in rows], j].sum() for kind in kinds] for j in range(len(mixture.weights))])
    return mixture, [kinds[i] for i in by_kind.argmax(1)]


def document_kinds(docs: DataFrame, doc_id: str, text: str, common_words: DataFrame, fewest_words: int = 5) -> DataFrame:
    """(doc_id, n_words, the statistics, kind, p_prose): each document's statistics and what it is.

    kind is the kind with the largest share; a text with fewer than
    ``fewest_words`` words, null and empty ones among them, is junk.
    """
    spark = docs.sparkSession
    statistics = materialise(text_statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", common_words), "statistics")
    examples = text_statistics(spark.createDataFrame(EXAMPLES, "kind string, text string"), "text", common_words)
    mixture, kinds = fit_mixture(statistics.where(F.col("n_words") >= fewest_words), examples)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(set(kinds))
        pick = np.array([[kind == n for n in names] for kind in kinds], float)
        for batch in batches:
            shares, _ = mixture.shares((_matrix(batch) - mixture.centre) / mixture.scale)
            of = shares @ pick
            kind = np.array(names, object)[of.argmax(1)]
            few = batch.column("n_words").to_numpy(zero_copy_only=False) < fewest_words
            kind[few] = "junk"
            prose = np.where(few, 0.0, of[:, names.index("prose")] if "prose" in names else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string()), pa.array(prose)], [*batch.schema.names, "kind", "p_prose"])

    return statistics.mapInArrow(name, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in statistics.schema)}, kind string, p_prose double")
