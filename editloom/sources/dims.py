"""Static dimension tables: small by definition, so they may be broadcast."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed as fx


def _seg(label, role, seq, protein=None):
    return {"label": label, "role": role, "seq": seq, "protein": protein}


def _reporter_insert(two_a_name, two_a, name):
    dna, aa = fx.REPORTERS[name]["dna"], fx.REPORTERS[name]["aa"]
    return {
        "ct": (two_a + dna + "TAA", [
            _seg(two_a_name, "PEPTIDE", two_a), _seg(name, "REPORTER", dna, (name, aa)), _seg("Stop", "STOP", "TAA")]),
        "nt": (dna + two_a, [
            _seg("Start", "START", "ATG"), _seg(name, "REPORTER", dna[3:], (name, aa[1:])),
            _seg(two_a_name, "PEPTIDE", two_a)]),
    }


def _tag_insert(label, tag):
    head = tag if tag.startswith("ATG") else "ATG" + tag
    return {
        "ct": (fx.LINKER + tag + "TAA", [
            _seg("Linker", "LINKER", fx.LINKER), _seg(label, "TAG", tag), _seg("Stop", "STOP", "TAA")]),
        "nt": (head + fx.LINKER, [
            _seg("Start", "START", "ATG"), _seg(label, "TAG", head[3:]), _seg("Linker", "LINKER", fx.LINKER)]),
    }


def _linked_reporter(name):
    dna, aa = fx.REPORTERS[name]["dna"], fx.REPORTERS[name]["aa"]
    return {"nt": (dna + fx.LINKER, [
        _seg("Start", "START", "ATG"), _seg(name, "REPORTER", dna[3:], (name, aa[1:])),
        _seg("Linker", "LINKER", fx.LINKER)])}


def _tag_with_mcherry(label, tag):
    dna, aa = fx.REPORTERS["mCherry"]["dna"], fx.REPORTERS["mCherry"]["aa"]
    return {
        "ct": (fx.LINKER + tag + fx.P2A + fx.MCHERRY_TAIL + "TAA", [
            _seg("Linker", "LINKER", fx.LINKER), _seg(label, "TAG", tag), _seg("P2A", "PEPTIDE", fx.P2A),
            _seg("mCherry", "REPORTER", dna, ("mCherry", aa)), _seg("Stop", "STOP", "TAA")]),
        "nt": (dna + fx.P2A + tag + fx.LINKER, [
            _seg("Start", "START", "ATG"), _seg("mCherry", "REPORTER", dna[3:], ("mCherry", aa[1:])),
            _seg("P2A", "PEPTIDE", fx.P2A), _seg(label, "TAG", tag), _seg("Linker", "LINKER", fx.LINKER)]),
    }


def _modular(core_name, core, detect_name, detect, marker):
    """Degron or tag core + detection tag, optionally with a P2A selection marker."""
    exact = core_name == "miniIAA7" and detect_name == "V5"
    if exact and marker is None:
        ct = fx.MINIIAA7_CT_SPACER + core + detect + "TAA"
        nt = "ATG" + detect + core + fx.MINIIAA7_NT_SPACER
        return {
            "ct": (ct, [_seg("Spacer", "LINKER", fx.MINIIAA7_CT_SPACER), _seg(core_name, "TAG", core),
                        _seg("V5 tag", "DETECT", detect), _seg("Stop", "STOP", "TAA")]),
            "nt": (nt, [_seg("Start", "START", "ATG"), _seg("V5 tag", "DETECT", detect), _seg(core_name, "TAG", core),
                        _seg("Spacer", "LINKER", fx.MINIIAA7_NT_SPACER)]),
        }
    if exact and marker == "BlastiR":
        ct = fx.MINIIAA7_CT_SPACER + core + detect + "AGCGCT" + fx.P2A_SELECTION + fx.BLASTIR_CORE + "TAA"
        nt = fx.BLASTIR_CORE + fx.P2A_SELECTION + detect + core + fx.MINIIAA7_NT_SPACER
        return {
            "ct": (ct, [_seg("Spacer", "LINKER", fx.MINIIAA7_CT_SPACER), _seg(core_name, "TAG", core),
                        _seg("V5 tag", "DETECT", detect), _seg("P2A", "PEPTIDE", fx.P2A_SELECTION),
                        _seg("BlastiR", "REPORTER", fx.BLASTIR_CORE + "TTAA"), _seg("Stop", "STOP", "TAA")]),
            "nt": (nt, [_seg("Start", "START", "ATG"), _seg("BlastiR", "REPORTER", nt[3:]),
                        _seg("P2A", "PEPTIDE", fx.P2A_SELECTION), _seg("V5 tag", "DETECT", detect),
                        _seg(core_name, "TAG", core), _seg("Spacer", "LINKER", fx.MINIIAA7_NT_SPACER)]),
        }
    head = [_seg("Linker", "LINKER", fx.LINKER), _seg(core_name, "TAG", core), _seg(detect_name, "DETECT", detect)]
    back = head[::-1]
    ct, nt = fx.LINKER + core + detect, detect + core + fx.LINKER
    if marker is None:
        return {"ct": (ct + "TAA", head + [_seg("Stop", "STOP", "TAA")]),
                "nt": ("ATG" + nt, [_seg("Start", "START", "ATG")] + back)}
    ct_marker, nt_marker = {
        "BlastiR": (fx.BLASTIR_CORE + "TTAA", "ATG" + fx.BLASTIR_CORE[12:]),
        "HygroR": (fx.HYGROR_CORE + "TAA", fx.HYGROR_CORE),
    }[marker]
    p2a = _seg("P2A", "PEPTIDE", fx.P2A_SELECTION)
    return {"ct": (ct + fx.P2A_SELECTION + ct_marker, head + [p2a, _seg(marker, "REPORTER", ct_marker)]),
            "nt": (nt_marker + fx.P2A_SELECTION + nt, [_seg(marker, "REPORTER", nt_marker), p2a] + back)}


@lru_cache(maxsize=1)
def inserts() -> dict[str, dict[str, tuple[str, list[dict]]]]:
    """name -> terminus ('ct'/'nt') -> (sequence, segments), in catalogue order."""
    raw = lambda name, seq: {"nt": (seq, [_seg(name.removeprefix("N:"), "TAG", seq)]),
                             "ct": (seq, [_seg(name, "TAG", seq)])}
    two = fx.TWO_HA_TAIL
    out = {
        "2xHA-only": _tag_insert("2xHA", fx.TWO_HA_ONLY_TAIL),
        "N:2xHA-dTAG-Linker": raw("N:2xHA-dTAG-Linker", two + fx.DTAG_CORE + fx.LINKER),
        "N:EGFP-Linker": _linked_reporter("EGFP"),
        "N:mStayGold2-Linker": _linked_reporter("mStayGold2"),
        "N:SD40-Linker": raw("N:SD40-Linker", fx.SD40_CORE + fx.LINKER),
        "N:dTAG-Linker": raw("N:dTAG-Linker", fx.DTAG_CORE + fx.LINKER),
        "N:mAID-Linker": raw("N:mAID-Linker", fx.MAID_CORE + fx.LINKER),
        "P2A-mCherry": _reporter_insert("P2A", fx.P2A, "mCherry"),
        "P2A-mScarlet": _reporter_insert("P2A", fx.P2A, "mScarlet"),
        "P2A-mStayGold2": _reporter_insert("P2A", fx.P2A, "mStayGold2"),
        "SD40-2xHA": _tag_insert("SD40-2xHA", fx.SD40_CORE + two),
        "SD40-2xHA-P2A-mCherry": _tag_with_mcherry("SD40-2xHA", fx.SD40_CORE + two),
        "T2A-EGFP": _reporter_insert("T2A", fx.T2A, "EGFP"),
        "T2A-mScarlet_I3": _reporter_insert("T2A", fx.T2A, "mScarlet_I3"),
        "T2A-mStayGold2": _reporter_insert("T2A", fx.T2A, "mStayGold2"),
        "dTAG-2xHA": _tag_insert("dTAG-2xHA", fx.DTAG_CORE + two),
        "dTAG-2xHA-P2A-mCherry": _tag_with_mcherry("dTAG-2xHA", fx.DTAG_CORE + two),
        "mAID-2xHA": _tag_insert("mAID-2xHA", fx.MAID_CORE + two),
        "mAID-2xHA-P2A-mCherry": _tag_with_mcherry("mAID-2xHA", fx.MAID_CORE + two),
    }
    cores = {"SD40": fx.SD40_CORE, "dTAG": fx.DTAG_CORE, "miniIAA7": fx.MINIIAA7_CORE}
    for core_name, core in cores.items():
        for detect_name, detect in (("HA", fx.HA_TAG), ("V5", fx.V5_TAG)):
            for marker in (None, "BlastiR", "HygroR"):
                name = f"{core_name}-{detect_name}" + (f"-P2A-{marker}" if marker else "")
                built = _modular(core_name, core, detect_name, detect, marker)
                out[name] = built
                # The 'N:' form is the N-terminal build; asked for as C-terminal it is one plain block.
                out["N:" + name] = {"nt": built["nt"],
                                    "ct": (built["nt"][0], [_seg("N:" + name, "TAG", built["nt"][0])])}
    return out


def cassette_names() -> list[str]:
    return list(inserts())


def insert_rows() -> list[tuple]:
    """(insert_name, terminus, insert_seq, insert_order) of every cassette form."""
    return [(name, end, forms[end][0], i) for i, (name, forms) in enumerate(inserts().items())
            for end in ("ct", "nt") if end in forms]


def segment_rows() -> list[tuple]:
    """(insert_name, terminus, seg_no, label, role, seg_start, seg_seq, protein_label, protein)."""
    rows = []
    for name, forms in inserts().items():
        for end, (_, segs) in forms.items():
            cursor = 0
            for i, s in enumerate(segs, 1):
                label, aa = s["protein"] or (None, None)
                rows.append((name, end, i, s["label"], s["role"], cursor, s["seq"],
                             fx.REPORTERS[label]["label"] if label else None, aa))
                cursor += len(s["seq"])
    return rows


def insert_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(insert_rows(), "insert_name string, terminus string, insert_seq string, insert_order int")


def segment_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        segment_rows(), "insert_name string, terminus string, seg_no int, label string, role string, seg_start int, "
                        "seg_seq string, protein_label string, protein string")


def internal_tag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, a) for k, (s, a) in fx.INTERNAL_TAGS.items()],
                                 "insert_name string, insert_seq string, insert_aa string")


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fx.FILTER_TIERS, "tier int, tier_id string, tier_label string, max0 int, max1 int, max2 int, "
                         "top_coverage boolean, min_oof double, cds_low double, cds_high double")


def construct_rows() -> list[tuple]:
    """(terminus, group_no, architecture, position, cassette) of the construct builder."""
    rows = []
    selections = ["dTAG-V5", "dTAG-HA", "SD40-V5", "SD40-HA", "miniIAA7-V5", "miniIAA7-HA"]
    for end, mark in (("nt", "N:"), ("ct", "")):
        groups = [
            ("fusion", (["N:EGFP-Linker", "N:mStayGold2-Linker"] if end == "nt" else []) + [mark + s for s in selections]),
            ("tag_p2a_selection", [f"{mark}{s}-P2A-{m}" for s in selections for m in ("BlastiR", "HygroR")]),
            ("t2a", ["T2A-EGFP", "T2A-mScarlet_I3", "T2A-mStayGold2"]),
            ("p2a", ["P2A-mCherry", "P2A-mScarlet", "P2A-mStayGold2"]),
        ]
        if end == "ct":
            groups.append(("tag_p2a_reporter", [f"{t}-2xHA-P2A-mCherry" for t in ("SD40", "dTAG", "mAID")]))
        for g, (arch, names) in enumerate(groups):
            rows += [(end, g, arch, i, name) for i, name in enumerate(names)]
    return rows


def construct_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(construct_rows(), "terminus string, group_no int, architecture string, position int, "
                                                   "cassette string")
