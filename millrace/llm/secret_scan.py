"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 characters or more, of those that keys and tokens are made of, that hold a digit or a capital
letter within, and every value announced as a secret ("password: x"), of any length and characters. The forest sees a candidate's length and make-up, its character transitions (how often neighbouring characters
change class, and how likely its letter pairs are in the text around it), how much of it the document's own
words cover, whether it looks like a path or address, and the words beside it. It is trained on labelled
findings: a bounded sample of candidates with a label each. `labelled_findings` makes EXAMPLES of them by rule: secrets of
many makes, and harmless values that look like them, in lines of prose. Texts are scanned whole, in tasks; training
sees feature rows alone, never texts.

Defined results: null and empty texts have no candidate; rows without an id keep null as theirs; repeated rows
give repeated findings; with findings of one label alone every candidate gets that label's score, without any a null score and verdict;
empty tables give empty results; other columns are ignored. Offsets count characters.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage, words

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_\-.@:]{16,}")
#: Labelled findings that the forest is trained on, at most.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 24, 10, 11
#: Findings that `labelled_findings` makes.
EXAMPLES = 6000
#: Characters on either side in which neighbouring words are looked for.
NEAR = 32
#: Words that announce a secret, in English, German, French and Spanish (fixed values), and what stands between them and it.
ANNOUNCING = (
    "token", "password", "passwd", "secret", "apikey", "api_key", "key", "auth", "credential", "bearer",
    "passwort", "kennwort", "schlüssel", "geheimnis", "zugangsdaten", "mot de passe", "clé", "jeton", "identifiant secret", "contraseña", "clave", "secreto",
)
SAYS = ("is", "ist", "lautet", "est", "es")
#: A value in quotes, or up to a space, after an announcing word and its sign.
ANNOUNCED = re.compile(r"(?i)(?:bearer[ \t]+|(?:" + "|".join(sorted(ANNOUNCING, key=len, reverse=True)) + r""")[\w\-]{0,20}["']?[ \t]*(?:[=:]|\b(?:""" + "|".join(SAYS) + r""")\b)[ \t]*)(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>]+))""")
#: Features of the words before and after: hashes, of which each has a place; the nearest word counts most.
BEFORE, AFTER = 32, 16
FEATURES = ["length", "digits", "upper", "lower", "marks", "entropy", "changes", "pairs", "covered", "path", "address", "announced", "assigned", "quoted", "hexadecimal"]
FEATURES += [f"before{i}" for i in range(BEFORE)] + [f"after{i}" for i in range(AFTER)]
_SCHEMA = "doc_id long, start long, stop long, candidate string, " + ", ".join(f"{f} double" for f in FEATURES)
_WORD = re.compile(r"[a-z]{3,}")
_NEIGHBOUR = re.compile(r"[^\W\d_]{2,}")
_TELLING = re.compile(r"\d|.[A-Z]")
#: Words of the lines around made findings (fixed values).
PROSE = "the a of and to in with for on from this that service server client when runs after before each deploy config value used here new old file note please see also check log main test data user team build time first last some other house river under light garden paper music friend window story".split()


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _neighbours(words_: list[str], places: int) -> list[float]:
    """The place of each word's hash holds one over its distance."""
    out = [0.0] * places
    for i, w in enumerate(words_):
        at = zlib.crc32(w.encode()) % places
        out[at] = max(out[at], 1 / (1 + i))
    return out


def describe(text: str, start: int, stop: int, vocabulary: set[str], pairs: Counter, total: int) -> list[float]:
    """FEATURES of text[start:stop]. vocabulary and pairs: the words and letter pairs (total of them) of the text's prose."""
    c = text[start:stop]
    n, low = len(c), c.lower()
    kinds = [_kind(x) for x in c]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
    seen = Counter(c)
    entropy = -sum(v / n * math.log2(v / n) for v in seen.values())
    letters = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    likely = sum(math.log((pairs[p] + 1) / (total + 676)) for p in letters) / len(letters) if letters else -10.0
    covered = sum(len(w) for w in _WORD.findall(low) if w in vocabulary) / n
    before, after = text[max(0, start - NEAR) : start].lower(), text[stop : stop + NEAR].lower()
    head = low.partition("=")[0] if "=" in low[:-2] else ""
    line = before.rsplit("\n", 1)[-1]
    announced = any(w in line[-24:] or w in head for w in ANNOUNCING)
    near = [*_NEIGHBOUR.findall(line), *_NEIGHBOUR.findall(head)][::-1][:4]
    return [
        n, kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n, entropy, changes, likely, covered,
        float(c.count("/") >= 2 or "://" in c), float("@" in c or c.count(".") >= 2), float(announced), float("=" in c[:-2] or before.rstrip(' "\'').endswith(("=", ":"))),
        float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]), float(all(x in "0123456789abcdef" for x in c)),
        *_neighbours(near, BEFORE), *_neighbours(_NEIGHBOUR.findall(after.split("\n", 1)[0])[:2], AFTER),
    ]


def _announced(text: str) -> Iterator[re.Match]:
    """The matches of ANNOUNCED, tried only where an announcing word stands."""
    low = text.lower()
    if len(low) != len(text):  # places differ
        yield from ANNOUNCED.finditer(text)
        return
    starts, end = set(), 0
    for word in ANNOUNCING:
        at = low.find(word)
        while at >= 0:
            starts.add(at)
            at = low.find(word, at + 1)
    for at in sorted(starts):
        if at >= end and (m := ANNOUNCED.match(text, at)):
            end = m.end()
            yield m


def spans_of(text: str) -> list[tuple[int, int]]:
    """Where the candidates are. Of a run and an announced value that overlap the run counts if it holds the value, else the value."""
    runs = [m.span() for m in CANDIDATE.finditer(text) if _TELLING.search(m.group())]
    values = []
    for m in _announced(text):
        a, b = m.span(m.lastindex)
        if m.lastindex == 3:
            b = a + (len(m.group(3).rstrip(".,;)")) or b - a)
        values.append((a, b))
    out, k = [], 0
    for a, b in values:
        while k < len(runs) and runs[k][1] <= a:
            out.append(runs[k])
            k += 1
        if k < len(runs) and runs[k][0] <= a and runs[k][1] >= b:
            continue
        while k < len(runs) and runs[k][0] < b:
            k += 1
        out.append((a, b))
    return out + runs[k:]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, stop, candidate and FEATURES of every candidate."""
    storage.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop_row, _, _ in words.chunks(batch.column(1)):
                part = batch.slice(row, stop_row - row)
                rows = []
                for doc, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    spans = spans_of(whole or "")
                    if not spans:
                        continue
                    prose = CANDIDATE.sub(" ", whole).lower()
                    vocabulary = set(_WORD.findall(prose))
                    pairs = Counter(map("".join, zip(prose, prose[1:])))
                    total = max(0, len(prose) - 1)
                    rows += [(doc, a, b, whole[a:b], *describe(whole, a, b, vocabulary, pairs, total)) for a, b in spans]
                cols = list(zip(*rows)) or [()] * (4 + len(FEATURES))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * len(FEATURES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "stop", "candidate", *FEATURES])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(storage.tidy(task), _SCHEMA)


def _made_secret(r: random.Random) -> str:
    """A line with a secret between \1 and \2."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_ = lambda of, n: "".join(r.choices(of, k=n))
    alnum, word = upper + lower + digits, r.choice(ANNOUNCING)
    say = lambda x: r.choice([f"{word} = \1{x}\2", f"{word}: \1{x}\2", f'{word}="\1{x}\2"', f'{word} = "\1{x}\2"', f"{word}: '\1{x}\2'", f"{word}=\1{x}\2", f"{word} {r.choice(SAYS)} \1{x}\2"])
    kind = r.randrange(10)
    if kind == 0:
        return r.choice(["\1{}\2", f"{word} \1{{}}\2", f"{word}: \1{{}}\2"]).format(r.choice(["AKIA", "ASIA"]) + any_(upper + (digits if r.random() < 0.8 else ""), 16))
    if kind == 1:
        return r.choice(["\1{}\2", f"{word}=\1{{}}\2"]).format(f"gh{r.choice('pousr')}_{any_(alnum, r.choice([36, 40]))}")
    if kind == 2:
        return r.choice(["\1{}\2", f"{word}=\1{{}}\2"]).format(f"{r.choice(['sk', 'rk', 'pk'])}_{r.choice(['live', 'prod'])}_{any_(alnum, r.randint(16, 32))}")
    if kind == 3:
        return r.choice(["\1{}\2", f"{word}: \1{{}}\2"]).format(f"xox{r.choice('bpa')}-{any_(digits, r.randint(10, 13))}-{any_(alnum, 24)}")
    if kind == 4:
        return r.choice(["\1{}\2", f"{word}: \1{{}}\2", "bearer \1{}\2"]).format(f"eyJ{any_(alnum, r.randint(15, 40))}.eyJ{any_(alnum + '_-', r.randint(20, 80))}.{any_(alnum + '_-', 43)}")
    if kind == 5:
        return say(any_(alnum, r.choice([16, 20, 24, 32, 40, 48, 64])))
    if kind in (6, 9):
        return say(any_(digits + "abcdef", r.choice([16, 18, 20, 24, 32, 40, 64])))
    if kind == 7:
        return say(any_(alnum + "+/", r.choice([43, 86])) + "=" * r.choice([1, 2]))
    return say(r.choice(PROSE).capitalize() + any_(digits, r.randint(2, 4)) + any_("!#$%&*?", r.randint(0, 2)) + any_(lower, r.randint(0, 4)))


def _made_harmless(r: random.Random) -> str:
    """A line with a harmless value between \1 and \2."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_ = lambda of, n: "".join(r.choices(of, k=n))
    words_ = lambda n, glue: glue.join(r.choices(PROSE, k=n))
    hexes, kind = digits + "abcdef", r.randrange(14)
    sums = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "revision", "etag", "hash", "fingerprint", "signature", "Prüfsumme", "empreinte", "huella", "somme de contrôle", "suma de control"]
    if kind == 0:
        return f"\1http{r.choice(['', 's'])}://{words_(2, '.')}.{r.choice(['com', 'org', 'net'])}/{words_(2, '/')}/{any_(r.choice([lower, upper + lower]) + digits, r.randint(1, 12))}{r.choice(['', '/' + any_(digits, 2) + '/' + r.choice(PROSE), '.html', '?id=' + any_(digits, 6)])}\2"
    if kind == 1:
        return f"{r.choice(['mail', 'write to', 'from', 'contact'])} \1{words_(2, '.')}{any_(digits, r.randint(1, 4))}@{words_(2, '-')}.example.com\2"
    if kind == 2:
        return f"{r.choice(['number', 'call', 'id', 'card', 'account'])} \1{any_(digits, r.randint(16, 24))}\2"
    if kind == 3:
        return f"{r.choice(['at', 'on', 'since'])} \1{r.randint(1990, 2030)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}.{any_(digits, 3)}\2"
    if kind == 4:
        return f"{r.choice(['row', 'job', 'request', 'uuid'])} \1{'-'.join(any_(hexes, n) for n in (8, 4, 4, 4, 12))}\2"
    if kind == 5:
        return f"{r.choice(sums)}{r.choice([' ', ': ', ' of it '])}\1{any_(hexes, r.choice([32, 40, 64]))}\2"
    if kind == 6:
        return f"{r.choice(['open', 'in', 'see'])} \1/{words_(r.randint(3, 5), '/')}{any_(digits, r.randint(0, 2))}.{r.choice(['py', 'txt', 'log', 'conf', 'Java'])}\2"
    if kind == 7 and r.random() < 0.5:
        return f"\1{words_(r.randint(4, 6), '').upper()}\2{r.choice(['', '.'])}"
    if kind == 7:
        return f"{r.choice(['call', 'class', 'use'])} \1{''.join(w.capitalize() for w in r.choices(PROSE, k=5))}{any_(digits, r.randint(0, 2))}\2"
    if kind == 8:
        return f"install \1{words_(2, '-')}-{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 200)}-{r.choice(['amd64', 'x86', 'py3'])}.{r.choice(['deb', 'whl', 'tar.gz'])}\2"
    if kind == 9:
        return f"the {r.choice(ANNOUNCING)} is \1{r.choice(PROSE)}\2 {words_(3, ' ')}"
    if kind == 10:
        return f"{r.choice(ANNOUNCING)}: \1{r.choice(['none', 'null', 'string', 'value', 'required', 'optional', 'true', r.choice(PROSE)])}\2"
    if kind == 11:  # of what is secret, the sum that everybody may know
        return f"{r.choice(['', 'the '])}{r.choice(ANNOUNCING)} {r.choice(['', 'file ', 'store ', 'ring ', words_(1, '') + ' '])}{r.choice(sums)}{r.choice([': ', ' is ', ' = ', ' '])}\1{any_(hexes, r.choice([32, 40, 64]))}\2"
    if kind == 12:
        thing = r.choice([f"the {r.choice(ANNOUNCING)} {r.choice(['', 'file ', 'store '])}", f"{r.choice(['', 'the '])}{r.choice(ANNOUNCING)}.{r.choice(['pem', 'json', 'bin', 'csv', 'zip'])}"])
        return f"{r.choice(sums)} {r.choice(['of', 'for', 'von', 'de'])} {thing}{r.choice(['is ', '= ', ': ', ' '])}\1{any_(hexes, r.choice([32, 40, 64]))}\2"
    return f"\1{words_(r.randint(3, 5), '-').title()}{any_(digits + upper, r.randint(0, 1))}\2"


def labelled_findings(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """candidates of made lines, with the label of each: n of them, half secrets; the same ones whenever it is called."""
    r, rows = random.Random(seed), []
    for i in range(n):
        line = (_made_secret if i % 2 else _made_harmless)(r)
        before, after = (" ".join(r.choices(PROSE, k=r.randint(3, 30))) for _ in range(2))
        value = line[line.index("\1") + 1 : line.index("\2")]
        rows.append((i, f"{before}{r.choice([' ', chr(10), '. '])}{line.replace(chr(1), '').replace(chr(2), '')}{r.choice([' ', chr(10)])}{after}", value))
    made = spark.createDataFrame(rows, "doc_id long, text string, value string")
    found = candidates(made).join(made.select("doc_id", "value"), "doc_id")
    meant = F.contains(F.col("candidate"), F.col("value")) | F.contains(F.col("value"), F.col("candidate"))
    return found.where(meant).drop("value").withColumn("label", (F.col("doc_id") % 2).cast("double"))


#: Forests that were fitted on made findings, by application, number and seed.
_FITTED: dict[tuple[str, int, int], object] = {}


def trained(spark: SparkSession, n: int = EXAMPLES, seed: int = SEED):
    """The forest for `labelled_findings`, fitted once in an application: these are the same whatever is scanned."""
    key = (spark.sparkContext.applicationId, n, seed)
    if key not in _FITTED:
        _FITTED[key] = train(labelled_findings(spark, n, seed))
    return _FITTED[key]


def known_formats(candidate: Column, announced: Column) -> Column:
    """A label by format alone, to hold verdicts against: 1 for formats that only secrets have, 0 for shapes known to be harmless, else null."""
    issued = candidate.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,})$")
    given = candidate.rlike(r"^([0-9a-f]{40}|[0-9a-f]{32}|password=[0-9a-f]{16,})$") & (announced > 0)
    shape = candidate.rlike(r"^([A-Za-z]+://[^@]*|www\.[^@]*|[^@:/=]+@[^@:/=]+\.[A-Za-z]{2,}\.?|[0-9+][0-9.:/\-]*)$")
    return F.when(issued | given, 1.0).when(shape & (announced == 0), 0.0)


def train(findings: DataFrame, label: str = "label", rows: int = TRAINING_ROWS):
    """A forest (Spark's), None without labels, from labelled findings: FEATURES and a label of 0 or 1; `rows` of them at most, those of the smallest hashes."""
    known = findings.where(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64(*FEATURES)).limit(rows)
    if known.isEmpty():
        return None
    known = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    return forest.fit(known)


def scan(found: DataFrame, forest, least: float = 0.5) -> DataFrame:
    """found (from `candidates`) with score, the forest's probability of a secret, and is_secret (score >= least)."""
    if forest is None:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(None).cast("boolean"))
    scored = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(found).withColumnRenamed("__features", "features"))
    chance = F.element_at(vector_to_array("probability"), -1) if forest.numClasses > 1 else F.lit(0.0)
    out = scored.withColumn("score", chance)
    return out.withColumn("is_secret", F.col("score") >= least).drop("features", "rawPrediction", "probability", "prediction")
