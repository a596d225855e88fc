"""Per-document text statistics, and a Gaussian mixture over them that tells prose from the rest (problem 10).

Statistics come from one pass over whole texts. They are standardised over all documents; a
mixture of full-covariance Gaussians is fitted to all of them by expectation-maximisation: each
round sums the sufficient statistics per partition and then by key, so the driver sees one fixed
number of sums whatever the corpus holds. Only the starting centres come from a bounded sample
(``START_ROWS``). Components get the name (prose, list, table, junk) of the inspected examples they
explain best, and the posterior alone decides: a document whose likeliest kind is not prose is named.

For the mixture ``running`` goes through a logistic curve around one half (``SLOPE``), which makes its two ends two narrow peaks and
leaves little between them; no threshold on it is applied.

``running`` is the share of non-blank characters in running sentences. A line that opens with list,
table, heading or template markup holds none; other lines are joined where they were hard-wrapped
and cut at sentence ends. A sentence opens with a capital, a digit or a quote (any letter where common words have their
usual share), ends in a full stop, a question or exclamation mark, and its paragraph has some, but not
only, common words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import durable

# Common words per language (fixed values).
COMMON = {
    "en": "the of and in to a is was for on as by with that it from at an are which be this had has have its his their not but or who they also after before were been one some most did no there he she about into than",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei war nach wird wurde sind einer um am dort oder seinem seit bis zum zur über fast alle wie was vor",
    "fr": "le la les de des du et en un une est que qui dans pour par sur au aux avec se ce il elle ne pas plus son sa ses était fut a été on cette ces dont y après comme ou d l s c n qu sont ont",
    "es": "el la los las de del y en un una es que se por con para su sus al lo como más fue era está son no sobre entre hasta desde este esta unos ya tiene cuando o muy fueron cerca después todo ha",
    "ru": "и в не на с по из что как был была было были это к от до для о за его ее её их а но же при год году года лет здесь там он она они который которое которые которая также рядом все после во со об где чем",
}
_COMMON = frozenset(w for ws in COMMON.values() for w in ws.split())
_MARKED = re.compile(r"(?:[*#:;|!{}=•·–—-]|\d{1,4}[.)]\s|__[A-Z]+__\s*$|\[\[(?:Category|Kategorie|Catégorie|Categoría|Категория|カテゴリ|File|Image|Datei|Fichier|Archivo|Файл|ファイル):|</?(?:references|table|tr|td|th|gallery|div|center|noinclude|includeonly|onlyinclude|nowiki|br|hr|ul|ol|li|pre|code|math)\b|%%|\$\{)", re.I)
_NOISE = re.compile(r"<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|\{\{[^{}]*\}\}|</?[A-Za-z][^<>]*>|'{2,5}|\[\[(?:[^\[\]|]*\|)?|\]\]", re.S | re.I)
_SPACE = re.compile(r"&(?:nbsp|#160|#xA0);")
_STOP = re.compile(r"[.!?…]+[\"'»”’)\]]*(?=\s|$)|[。！？]+[」』]?")
_WORDS = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_ENDS = re.compile(r"[.!?。！？…][\"'»”’)\]]*$")
WRAPPED = 50
FEATURES = ("log_words", "word_length", "symbols", "line_ends", "common", "running", "digits", "distinct", "line_length", "marked")


def _running(block: str) -> float:
    """Share of a block's cleaned text that is in running sentences."""
    text = _SPACE.sub(" ", _NOISE.sub("", block)).strip()
    if not text:
        return 0.0
    words = _WORDS.findall(text)
    if len(words) < 2:
        return 0.0
    kana = len(_KANA.findall(text))
    share = sum(w.lower() in _COMMON for w in words) / len(words)
    if kana:
        if kana < 0.1 * len(text):
            return 0.0
    elif share > 0.8 or share < (0.1 if len(words) > 12 else 0.0):
        return 0.0
    good, end = 0, 0
    for m in _STOP.finditer(text):
        begin, end = end, m.end()
        s = text[begin:end].lstrip()
        if kana or len(s) <= 5 and good or len(s) > 5 and (not s[0].islower() and (s[0].isalnum() or s[0] in "\"'«„“¿¡(") or 0.15 <= share <= 0.7):
            good += end - begin
    tail = text[end:].strip()
    if tail and good and len(tail) > 5 and (kana or (tail[0].isupper() and sum(w.lower() in _COMMON for w in _WORDS.findall(tail)) >= 2)):
        good += len(text) - end  # cut off inside its last sentence
    elif tail and not good and len(text) > 60 and (kana > 10 or (text[0].isupper() and 0.2 <= share <= 0.7 and len(words) >= 12 and len(set(words)) > 0.5 * len(words) and block.count("\n") <= len(block) / WRAPPED)):
        good += len(text)
    return min(1.0, good / len(text))


def profile(text: str) -> list[float]:
    """The statistics named in FEATURES."""
    lines = [x.strip() for x in text.split("\n")]
    full = [x for x in lines if x]
    blank_free = sum(len(x) - x.count(" ") - x.count("\t") for x in full)
    running, block, marked, depth = 0.0, [], 0, 0

    def close() -> float:
        if not block:
            return 0.0
        joined = "\n".join(block)
        size = sum(len(x) - x.count(" ") - x.count("\t") for x in block)
        block.clear()
        return size * _running(joined)

    for line in lines:
        inside = depth > 0
        if "{{" in line or "}}" in line:
            depth = max(0, depth + line.count("{{") - line.count("}}"))
        if not line:
            running += close()
            continue
        if inside and (depth or line.endswith("}}")) or (_MARKED.match(line) and not _opens_text(line)):
            marked += 1
            running += close()
            continue
        if block and len(block[-1]) < WRAPPED and not line[0].islower():
            running += close()
        block.append(line)
    running += close()
    words = [w.lower() for w in _WORDS.findall(text)]
    n, chars = max(1, len(words)), max(1, blank_free)
    letters = sum(map(len, words))
    digits = sum(map(text.count, "0123456789"))
    return [
        float(np.log1p(len(words))), min(30.0, letters / n), max(0, blank_free - letters - digits) / chars,
        sum(1 for x in full if _ENDS.search(x)) / max(1, len(full)), sum(w in _COMMON for w in words) / n,
        running / chars, digits / chars, len(set(words)) / n, float(np.log1p(blank_free / max(1, len(full)))), marked / max(1, len(full)),
    ]


def _opens_text(line: str) -> bool:
    """A template or tag that opens a line of running text, as in ``{{lang|x}} is a village.``"""
    if line[:2] == "{{" and "}}" in line:
        return len(line) - line.rfind("}}") > 30
    return line[:2] == "''" or (line[:2] in ("– ", "— ") and len(line) > 120)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [profile(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def document_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>): the statistics of every document with non-null, non-empty text.

    Repeated documents each get a row; a text of white space only has no words and no sentences.
    """
    rows = documents.where(F.col(f"`{doc_id}`").isNotNull() & (F.col(f"`{text}`") != "")).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_profiles, "doc_id bigint, x array<double>")


#: Steepness of the logistic curve that ``running`` goes through for the mixture.
SLOPE = 24.0
#: Greatest deviation of a component along the curve.
SPREAD = 0.05
_RUNNING = FEATURES.index("running")


def inputs(x: np.ndarray) -> np.ndarray:
    """Statistics as the mixture sees them."""
    out = np.array(x, float)
    out[:, _RUNNING] = 1 / (1 + np.exp(-SLOPE * (out[:, _RUNNING] - 0.5)))
    return out


def _input(k: int) -> Column:
    x = F.col("x")[k]
    return 1 / (1 + F.exp(-SLOPE * (x - 0.5))) if k == _RUNNING else x


class Mixture:
    """Weights, means and covariances of a Gaussian mixture over standardised statistics."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        self.shift, self.scale, self.weights, self.means, self.covariances = shift, scale, weights, means, covariances

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        z = (inputs(x) - self.shift) / self.scale
        out = np.empty((len(z), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            low = np.linalg.cholesky(c)
            y = np.linalg.solve(low, (z - m).T)
            out[:, k] = np.log(w) - 0.5 * (y * y).sum(0) - np.log(np.diag(low)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def shares(self, x: np.ndarray) -> np.ndarray:
        j = self.log_joint(x)
        j = np.exp(j - j.max(1, keepdims=True))
        return j / j.sum(1, keepdims=True)


COMPONENTS, ROUNDS, START_ROWS, FLOOR = 10, 20, 4000, 1e-3


def _sums(model: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = model.means.shape
        total = np.zeros(k * (1 + d + d * d) + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            joint = model.log_joint(x)
            top = joint.max(1, keepdims=True)
            r = np.exp(joint - top)
            total[-1] += (top[:, 0] + np.log(r.sum(1))).sum()
            r /= r.sum(1, keepdims=True)
            z = (inputs(x) - model.shift) / model.scale
            for i in range(k):
                at = i * (1 + d + d * d)
                total[at] += r[:, i].sum()
                total[at + 1 : at + 1 + d] += r[:, i] @ z
                total[at + 1 + d : at + 1 + d + d * d] += ((z * r[:, i : i + 1]).T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], names=["slot", "value"])

    return run


def _narrow(covariances: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Covariances whose deviation along ``running`` is SPREAD at most, so that no component covers both of its ends."""
    covariances = covariances.copy()
    most = SPREAD / scale[_RUNNING]
    shrink = np.minimum(1.0, most / np.sqrt(covariances[:, _RUNNING, _RUNNING]))
    covariances[:, _RUNNING, :] *= shrink[:, None]
    covariances[:, :, _RUNNING] *= shrink[:, None]
    return covariances


def fit_mixture(stats: DataFrame, components: int = COMPONENTS, rounds: int = ROUNDS, start_rows: int = START_ROWS, seed: int = 3) -> Mixture | None:
    """EM over all rows of ``stats`` (a written table); None if there are none.

    ``start_rows``: about how many rows (those of smallest hash) the starting centres are chosen from.
    """
    d = len(FEATURES)
    moments = stats.agg(F.count("*"), *[f for k in range(d) for f in (F.avg(_input(k)), F.stddev_pop(_input(k)))]).first()
    if not moments[0]:
        return None
    shift = np.array(moments[1::2], float)
    scale = np.maximum(np.array(moments[2::2], float), 1e-3)
    share = min(1.0, start_rows / moments[0])
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))
    start = [r[0] for r in stats.where(chosen).select("x").collect()] or [stats.select("x").first()[0]]
    z = (inputs(np.array(start)) - shift) / scale
    rng = np.random.default_rng(seed)
    centres = [z[rng.integers(len(z))]]
    while len(centres) < components:  # far points first
        far = np.min([((z - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(z[rng.choice(len(z), p=far / far.sum())] if far.sum() > 0 else z[0])
    means = np.array(centres)
    for _ in range(10):  # a few k-means steps on the sample
        near = ((z[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([z[near == k].mean(0) if (near == k).any() else means[k] for k in range(components)])
    model = Mixture(shift, scale, np.full(components, 1 / components), means, _narrow(np.array([np.eye(d)] * components), scale))
    last, size = -np.inf, 1 + d + d * d
    for _ in range(rounds):
        rows = stats.select("x").mapInArrow(_sums(model), "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(components * size + 1)
        for slot, value in rows:
            total[slot] = value
        parts = total[:-1].reshape(components, size)
        n = np.maximum(parts[:, 0], 1e-9)
        means = parts[:, 1 : 1 + d] / n[:, None]
        covariances = parts[:, 1 + d :].reshape(components, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
        dead = parts[:, 0] < 1e-6
        means[dead], covariances[dead] = model.means[dead], np.eye(d)
        covariances = _narrow((covariances + covariances.transpose(0, 2, 1)) / 2 + FLOOR * np.eye(d), scale)
        weights = np.maximum(n / n.sum(), 1e-12)
        model = Mixture(shift, scale, weights / weights.sum(), means, covariances)
        if total[-1] - last < 1e-4 * moments[0]:
            break
        last = total[-1]
    return model


#: Inspected examples: kinds of text as they were found in encyclopedia dumps.
EXAMPLES = [
    ("prose", "The old mill of Harford was built in 1783 by a local family. It was moved twice, and most of its walls were lost in the fire of 1821.\n\nSince then it has belonged to the town. Many of the houses around it were closed after the war, although few records survive."),
    ("prose", "It lies about 40 km from the coast and has a [[small]] harbour. The name comes from a bridge that was ''described'' by the people of the valley after a long dry summer. He was born there and worked as a keeper of the canal until 1885."),
    ("prose", "{{cleanup}}\n\nDer Ort hat 1443 Einwohner und gehört seit 1909 zu der Gemeinde. Ein Brand zerstörte 1864 fast alle Häuser, wie alte Karten zeigen.\n\n== Lage ==\n\nEr liegt etwa 40 Kilometer von der Stadt entfernt und hat einen Garten."),
    ("prose", "Selon le recensement de 1628, 9211 personnes y habitaient avec l'aide des voisins. Un incendie a détruit le château en 1661, et le nom vient d'un ancien pont construit par les habitants de la vallée."),
    ("prose", "Según el censo de 1734, allí vivían 7546 personas. En 1867 el jardín fue fundado y después se unió con el puente del pueblo."),
    ("prose", "По переписи 1811 года здесь жили 528 человек. В 1739 году сад был перенесён, а потом на его месте появился старый канал."),
    ("prose", "この橋がいつ廃止されたかは分かっていない。火事で村は失われたが、古い橋は残っている。1723年に学校が開業された。"),
    ("list", "* Northford\n* [[Old Harbour]]\n* Ann Miller (1749–2015)\n* late river, Westby\n* [[Southmill]]\n* John Carter\n* [[Eastford]] (1732–2003)"),
    ("list", "1. wooden bridge, Northford\n2. Westmill\n3. [[Eastford]]\n4. John Carter\n5. [[Ann Miller]] (1895–2002)\n6. Southby"),
    ("list", "• Northford\n• [[Westmill]]\n• abandoned island, Eastby\n• Southmill\n• Ann Miller"),
    ("table", "{| class=\"wikitable\"\n! Name !! Count !! Share\n|-\n| Northford || 25865 || 15.8\n|-\n| Westmill || 37679 || 50.3\n|-\n| Eastby || 15484 || 2.1\n|}"),
    ("table", "Northford;89260;32.1;yes\nWestmill;38913;57.6;no\nEastby;87528;75.6;yes\nSouthmill;21001;97.1;no"),
    ("table", "Northford     29289          37.1           no\nWestmill      19637          28.5           yes\nEastby        93337          76.5           no"),
    ("table", "<table>\n<tr><td>Northford</td><td>46241</td><td>68.3</td></tr>\n<tr><td>Westmill</td><td>75069</td><td>58.6</td></tr>\n</table>"),
    ("junk", "#REDIRECT [[Northford]]"),
    ("junk", "northford northford northford northford\nnorthford northford northford\nnorthford northford northford northford northford"),
    ("junk", "of the and to in from by with is that of on at was it as be this are the of and a to in for from it is of the by on"),
    ("junk", "dfkqyf usirfauq raahudt pgo quup ohygswilr qryf\npwyypidd trofsf\njlhypty\nfdaatut aeqotog dqjwfd uwrst"),
    ("junk", "7jwNoeScRN04rm5iWv031GiH2NjsoFMOp8YGqp8mgprm1QMjhSRVIUpICQ5iBROPt9Du6Rat65Tsw6QwakbZpJf3P7tEpi47np"),
    ("junk", "{{#switch:{{{1}}}|a=1|b=2|#default=0}}\n{{{year|}}}\n<noinclude>{{doc}}</noinclude>\n${2}\n| label5 = {{{img|}}}\n<includeonly>[[Category:{{{year}}}]]</includeonly>"),
    ("junk", "there harbour old windows school people has praised lives trade 1778 though near lies from species and abandoned planned small 7135 buildings km it three of seeds"),
]


def name_components(model: Mixture) -> list[str]:
    """The kind of each component: that of the examples it explains; without any, of the example nearest to its mean."""
    x = np.array([profile(t) for _, t in EXAMPLES])
    kinds = [k for k, _ in EXAMPLES]
    shares, names = model.shares(x), []
    z = (inputs(x) - model.shift) / model.scale
    running = model.means[:, _RUNNING] * model.scale[_RUNNING] + model.shift[_RUNNING]
    for k in range(len(model.weights)):
        votes: dict[str, float] = {}
        for kind, share in zip(kinds, shares[:, k]):
            votes[kind] = votes.get(kind, 0.0) + share
        best = max(votes, key=votes.get)
        if votes[best] <= 0.05:
            best = kinds[int(((z - model.means[k]) ** 2).sum(1).argmin())]
        names.append("junk" if best == "prose" and running[k] < 0.5 else best)  # no prose without sentences
    return names


def classify(stats: DataFrame, model: Mixture | None) -> DataFrame:
    """(doc_id, x, kind, prose): the likeliest kind, and the share of the posterior on prose components."""
    schema = "doc_id bigint, x array<double>, kind string, prose double"
    if model is None:
        return stats.sparkSession.createDataFrame([], schema)
    names = name_components(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = sorted(set(names))
        member = np.array([[n == k for k in kinds] for n in names], float)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            by = model.shares(x) @ member
            prose = by[:, kinds.index("prose")] if "prose" in kinds else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([kinds[i] for i in by.argmax(1)]), pa.array(prose)], names=["doc_id", "x", "kind", "prose"])

    return stats.select("doc_id", "x").mapInArrow(run, schema)


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, kind): documents of which the mixture's components that are not prose explain more than half."""
    stats = durable(document_statistics(documents)).df
    return classify(stats, fit_mixture(stats)).where("prose < 0.5").select("doc_id", F.when(F.col("kind") == "prose", "junk").otherwise(F.col("kind")).alias("kind"))
