"""One consistent form for text that looks the same in different characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.spread import spread_join
from ..storage import cut

# Letters and marks of Cyrillic, Greek, Armenian, Cherokee, Coptic, Lisu and others that are drawn like a Latin
# one of the same case, as "other latin" pairs.
LOOKALIKES = """
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  Ѕ S  І I  Ј J  Ԛ Q  Ԝ W  Ү Y  Ԍ G  Ѵ V  Ӏ I  Ӕ Æ
а a  е e  о o  р p  с c  у y  х x  ѕ s  і i  ј j  һ h  ԛ q  ԝ w  ԁ d  ӏ l  ѵ v  ӕ æ
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  Ϳ J  Ϲ C  Ϻ M
ο o  ν v  ρ p  ϲ c  ϳ j  ı i  ɡ g  ɑ a
Օ O  Տ S  Ս U  Լ L  օ o  ս u  ո n  հ h  զ q  ց g  յ j
Ꭰ D  Ꭱ R  Ꭲ T  Ꭺ A  Ꭻ J  Ꭼ E  Ꮃ W  Ꮇ M  Ꮋ H  Ꮐ G  Ꮓ Z  Ꮪ S  Ꮩ V  Ꮮ L  Ꮯ C  Ꮲ P  Ꮶ K  Ᏼ B  ꮃ w  ꮓ z  ꮩ v  ꮪ s  ꮯ c
Ⲏ H  Ⲓ I  Ⲕ K  Ⲙ M  Ⲛ N  Ⲟ O  Ⲣ P  Ⲥ C  Ⲧ T  Ⲭ X  ⲟ o  ⲣ p  ⲥ c
ꓐ B  ꓑ P  ꓓ D  ꓔ T  ꓖ G  ꓗ K  ꓙ J  ꓚ C  ꓜ Z  ꓝ F  ꓟ M  ꓠ N  ꓡ L  ꓢ S  ꓣ R  ꓦ V  ꓧ H  ꓪ W  ꓫ X  ꓬ Y  ꓮ A  ꓰ E  ꓲ I  ꓳ O  ꓴ U
‐ -  ‑ -  ∕ /  ⁄ /  ∶ :  ։ :  ․ .
"""
# Compatibility forms that differ in width, in joining or as a ligature only.
SAME_LOOK = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<noBreak>")
# Joined letters (Latin, Armenian and Lao ligatures, digraphs) and Roman numerals under "<compat>".
JOINED = [*range(0x132, 0x134), 0x149, 0x587, 0xEDC, 0xEDD, *range(0x2160, 0x2180), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)]
# Ends of the names of letters that a base with these combining marks is drawn like.
OVERLAID = {
    "STROKE": "\u0335\u0336", "SLANTED STROKE": "\u0337\u0338", "DIAGONAL STROKE": "\u0337", "OBLIQUE STROKE": "\u0338", "MIDDLE TILDE": "\u0334",
    "PALATAL HOOK": "\u0321", "RETROFLEX HOOK": "\u0322",
}
# Letters whose plain stroke is slanted.
SLANTED = "ACELOacelo"
#: Marks above a dotted letter, under which its dot isn't drawn unless it is written.
ABOVE = "\u0300\u0301\u0302\u0303\u0304\u0306\u0308\u030a\u030b\u030c"
#: What shows nothing: format and control characters and fillers; but not the marks that enclose digits, controls of
#: hieroglyphs, notes and shorthand, which shape what is around them, and overrides, which turn letters round.
INVISIBLE = r"[[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}]--[\p{Prepended_Concatenation_Mark}\U00013430-\U0001345F\U0001BCA0-\U0001BCA3\U0001D173-\U0001D17A\u202D\u202E\s\x1c-\x1f]]"
#: Joiners that change no shape. A non-joiner shows between letters that would join and after a sign that joins consonants;
#: a joiner shows there, at a letter that has nothing to join with, and between pictures.
IDLE_JOINERS = (
    r"(?<!\p{ccc=9})(?:"
    r"\u200c(?!(?<=[\p{jt=D}\p{jt=L}]\p{M}*+\u200c)\p{M}*+[\p{jt=D}\p{jt=R}])"
    r"|\u200d(?!(?<=\p{Extended_Pictographic}[\ufe0f\p{Emoji_Modifier}]*+\u200d)\p{Extended_Pictographic})"
    r"(?!(?<=[\p{jt=D}\p{jt=L}]\p{M}*+\u200d)(?!\p{M}*+[\p{jt=D}\p{jt=R}]))"
    r"(?!(?<![\p{jt=D}\p{jt=L}]\p{M}*+\u200d)\p{M}*+[\p{jt=D}\p{jt=R}]))"
)
#: Runs of printable ASCII are left alone but for a last letter that marks may follow.
CLUSTERS = r"[\x20-\x7e]+(?=[\x20-\x7e]|$)(*SKIP)(*FAIL)|\X"


class LookTransducer:
    """Longest-match transducer over grapheme clusters, compiled from the rules above.

    States are the nodes of a trie of source sequences of one character or more; each final state has an output.
    ``run`` reads a text once: invisible characters vanish, widths, joined forms,
    look-alikes and letters built of a base and an overlaid mark take their plain letters, a base with its marks is composed, and
    every run of blanks is one space (none at the ends). Joiners stay where they change a shape, tags in flags.
    Building fails if two rules give one source different outputs, or if an output would itself be changed for ever.
    """

    def __init__(self) -> None:
        self.table: dict[str, str] = {}
        given = LOOKALIKES.split()
        for other, plain in zip(given[::2], given[1::2], strict=True):
            self._add(other, plain)
        # beyond these are ideographs and private characters only
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE1000))))
        for char in regex.findall(INVISIBLE, every, regex.V1):
            self._add(char, "")
        for char in regex.findall(r"[\s\x1c-\x1f]", every):
            self._add(char, " ")
        for char in every:
            if char in self.table:
                continue
            mapping = unicodedata.decomposition(char).split()
            if mapping and (mapping[0] in SAME_LOOK or ord(char) in JOINED):
                self._add(char, "".join(chr(int(x, 16)) for x in mapping[1:]))
            elif char.isalpha() and not mapping and ord(char) < 0x10000 and (m := re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z]) WITH (.+)", unicodedata.name(char, ""))):
                base = m[2] if m[1] == "CAPITAL" else m[2].lower()
                for mark in OVERLAID.get("SLANTED STROKE" if m[3] == "STROKE" and base in SLANTED else m[3], ""):
                    self._add(base + mark, char)
        for dotted in "ij":
            for bare in (dotted, "ı" if dotted == "i" else "ȷ"):
                self._add(f"{bare}\u0307", dotted)
                for mark in ABOVE:  # a written dot shows beside a further mark
                    self._add(f"{bare}\u0307{mark}", f"{dotted}\u0307{mark}")
        self._compile()
        self._close()
        self.cluster = lru_cache(maxsize=1 << 16)(self._cluster)
        self.clusters, self.idle = regex.compile(CLUSTERS), regex.compile(IDLE_JOINERS)

    def _add(self, source: str, target: str) -> None:
        source = unicodedata.normalize("NFD", source) if len(source) > 1 else source
        if self.table.setdefault(source, target) != target:
            raise ValueError(f"two outputs for {source!r}: {self.table[source]!r} and {target!r}")

    def _compile(self) -> None:
        self.trie: dict = {}
        for source, target in self.table.items():
            node = self.trie
            for char in source:
                node = node.setdefault(char, {})
            node[""] = target

    def _close(self) -> None:
        """Outputs as fixed points, so that one pass is enough."""
        for source, target in list(self.table.items()):
            seen = set()
            while (nxt := self._once(target)) != target:
                if target in seen:
                    raise ValueError(f"the rules for {source!r} go round")
                seen.add(target)
                target = nxt
            self.table[source] = target
        self._compile()

    def _cluster(self, cluster: str) -> str:
        """The output for one cluster; again while an output makes a longer source with the mark behind it. Clusters are short and remembered."""
        while (out := self._once(cluster)) != cluster:
            cluster = out
        return out

    def _once(self, cluster: str) -> str:
        """Longest matches in the trie, then base and marks composed."""
        parts = unicodedata.normalize("NFD", cluster)
        flag = parts[:1] == "\U0001f3f4"
        out, at = [], 0
        while at < len(parts):
            node, k, best, end = self.trie, at, None, at
            while k < len(parts) and parts[k] in node:
                node = node[parts[k]]
                k += 1
                if "" in node:
                    best, end = node[""], k
            if best is None or parts[at] in "\u200c\u200d" or (flag and 0xE0020 <= ord(parts[at]) <= 0xE007F):
                out.append(parts[at])
                at += 1
            else:
                out.append(best)
                at = end
        return unicodedata.normalize("NFC", "".join(out))

    def run(self, text: str) -> str:
        if not text.isascii() or not text.isprintable():
            if "\u200c" in text or "\u200d" in text:
                text = self.idle.sub("", text)
            # marks may follow an invisible character, which must not part them from their base
            text = self.clusters.sub(lambda m: self.cluster(m[0]), text)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
        return " ".join(x for x in text.split(" ") if x)


@lru_cache(maxsize=1)
def transducer() -> LookTransducer:
    return LookTransducer()


def with_form(rows: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``rows`` with the consistent form of ``text``; null stays null, and a text that shows nothing gives ''."""
    at = rows.columns.index(text)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = transducer().run
        for batch in batches:
            texts = batch.column(at).to_pylist()
            made = pa.array([None if t is None else run(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return rows.mapInArrow(forms, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


class SameLook:
    """Rows whose texts look the same in different characters.

    ``members``: (_id, _form, _string, _class, _n): the rows of forms with several strings; the class is the
    form's smallest id, _n the rows of the string. ``strings``: a row for each such string. What is kept of a
    text is two digests. Null texts, texts that show nothing and rows without id never count. Forms and strings of very many
    rows are joined in slices.
    """

    def __init__(self, rows: DataFrame, id_col: str, text: str) -> None:
        # the forms are made once
        shown = with_form(rows.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text").where(F.col("form") != "")
        keyed = cut(
            shown.select(F.col("_id"), F.unhex(F.md5("form")).alias("_form"), F.unhex(F.md5("_text")).alias("_string")).where(F.col("_id").isNotNull()),
            "looks",
        )
        strings = keyed.groupBy("_form", "_string").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
        forms = strings.groupBy("_form").agg(F.count("*").alias("_strings"), F.min("_least").alias("_class"), F.sum("_n").alias("_rows")).where("_strings > 1")
        self.forms = cut(forms, "forms")
        self.kinds, self.rows = (x or 0 for x in self.forms.agg(F.sum("_strings"), F.sum("_rows")).first())
        of_form = self.forms.select("_form", "_class", "_strings", F.col("_rows").alias("_all"))
        self.strings = cut(
            spread_join(strings.select("_form", "_string", "_n"), of_form.withColumn("_size", F.col("_strings")), ["_form"], "_size", self.kinds, F.col("_string")), "strings"
        )
        self.members = cut(
            spread_join(keyed, self.strings.select("_form", "_string", "_class", "_n", "_all", F.col("_n").alias("_size")), ["_form", "_string"], "_size", self.rows, F.col("_id")), "members"
        )

    def classes(self) -> DataFrame:
        """(id, class_id, links): each row's class and the number of its rows with another string."""
        return self.members.select(F.col("_id").alias("id"), F.col("_class").alias("class_id"), (F.col("_all") - F.col("_n")).alias("links"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b) of rows of one form and different strings, id_a < id_b; strings are paired first, then expanded to their rows."""
        one = self.strings.select("_form", "_string")
        other = self.strings.select("_form", F.col("_string").alias("_other"), F.col("_n").alias("_m"), F.col("_strings").alias("_size"))
        kinds = spread_join(one, other, ["_form"], "_size", self.kinds, F.col("_string")).where(F.col("_string") < F.col("_other"))
        sized = kinds.join(self.strings.select("_form", "_string", F.col("_n").alias("_size")), ["_form", "_string"])
        left = self.members.select("_form", "_string", F.col("_id").alias("_a"))
        half = spread_join(left, sized, ["_form", "_string"], "_size", self.rows, F.col("_a"))
        right = self.members.select("_form", F.col("_string").alias("_other"), F.col("_id").alias("_b"))
        both = spread_join(right, half.withColumn("_size", F.col("_m")), ["_form", "_other"], "_size", self.rows, F.col("_b"))
        return both.where(F.col("_a") != F.col("_b")).select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b")).distinct()


def same_look_pairs(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    return SameLook(rows, id_col, text).pairs()
