"""Lookup tables, thresholds, texts and sequence modules.

All values here must stay exactly as they are for results to agree with earlier runs
of the same designs; none of them is derived from data.
"""

from __future__ import annotations

# Protein coding sequences and reference proteins of the order-ready reporters.
REPORTERS = {
    "EGFP": {
        "label": "FPbase EGFP",
        "url": "https://www.fpbase.org/protein/egfp/",
        "dna": "ATGGTGAGCAAGGGCGAGGAGCTGTTCACCGGGGTGGTGCCCATCCTGGTCGAGCTGGACGGCGACGTAAACGGCCACAAGTTCAGCGTGTCCGGCGAGGGCGAGGGCGATGCCACCTACGGCAAGCTGACCCTGAAGTTCATCTGCACCACCGGCAAGCTGCCCGTGCCCTGGCCCACCCTCGTGACCACCCTGACCTACGGCGTGCAGTGCTTCAGCCGCTACCCCGACCACATGAAGCAGCACGACTTCTTCAAGTCCGCCATGCCCGAAGGCTACGTCCAGGAGCGCACCATCTTCTTCAAGGACGACGGCAACTACAAGACCCGCGCCGAGGTGAAGTTCGAGGGCGACACCCTGGTGAACCGCATCGAGCTGAAGGGCATCGACTTCAAGGAGGACGGCAACATCCTGGGGCACAAGCTGGAGTACAACTACAACAGCCACAACGTCTATATCATGGCCGACAAGCAGAAGAACGGCATCAAGGTGAACTTCAAGATCCGCCACAACATCGAGGACGGCAGCGTGCAGCTCGCCGACCACTACCAGCAGAACACCCCCATCGGCGACGGCCCCGTGCTGCTGCCCGACAACCACTACCTGAGCACCCAGTCCGCCCTGAGCAAAGACCCCAACGAGAAGCGCGATCACATGGTCCTGCTGGAGTTCGTGACCGCCGCCGGGATCACTCTCGGCATGGACGAGCTGTACAAG",
        "aa": "MVSKGEELFTGVVPILVELDGDVNGHKFSVSGEGEGDATYGKLTLKFICTTGKLPVPWPTLVTTLTYGVQCFSRYPDHMKQHDFFKSAMPEGYVQERTIFFKDDGNYKTRAEVKFEGDTLVNRIELKGIDFKEDGNILGHKLEYNYNSHNVYIMADKQKNGIKVNFKIRHNIEDGSVQLADHYQQNTPIGDGPVLLPDNHYLSTQSALSKDPNEKRDHMVLLEFVTAAGITLGMDELYK",
    },
    "mCherry": {
        "label": "FPbase mCherry",
        "url": "https://www.fpbase.org/protein/mcherry/",
        "dna": "ATGGTGAGCAAGGGCGAGGAGGACAACATGGCCATCATCAAGGAGTTCATGCGCTTCAAGGTGCACATGGAGGGCAGCGTGAACGGCCACGAGTTCGAGATCGAGGGCGAGGGCGAGGGCCGCCCCTACGAGGGCACCCAGACCGCCAAGCTGAAGGTGACCAAGGGCGGCCCCCTGCCCTTCGCCTGGGACATCCTGAGCCCCCAGTTCATGTACGGCAGCAAGGCCTACGTGAAGCACCCCGCCGACATCCCCGACTACCTGAAGCTGAGCTTCCCCGAGGGCTTCAAGTGGGAGCGCGTGATGAACTTCGAGGACGGCGGCGTGGTGACCGTGACCCAGGACAGCAGCCTGCAGGACGGCGAGTTCATCTACAAGGTGAAGCTGCGCGGCACCAACTTCCCCAGCGACGGCCCCGTGATGCAGAAGAAGACCATGGGCTGGGAGGCCAGCAGCGAGCGCATGTACCCCGAGGACGGCGCCCTGAAGGGCGAGATCAAGCAGCGCCTGAAGCTGAAGGACGGCGGCCACTACGACGCCGAGGTGAAGACCACCTACAAGGCCAAGAAGCCCGTGCAGCTGCCCGGCGCCTACAACGTGAACATCAAGCTGGACATCACCAGCCACAACGAGGACTACACCATCGTGGAGCAGTACGAGCGCGCCGAGGGCCGCCACAGCACCGGCGGCATGGACGAGCTGTACAAG",
        "aa": "MVSKGEEDNMAIIKEFMRFKVHMEGSVNGHEFEIEGEGEGRPYEGTQTAKLKVTKGGPLPFAWDILSPQFMYGSKAYVKHPADIPDYLKLSFPEGFKWERVMNFEDGGVVTVTQDSSLQDGEFIYKVKLRGTNFPSDGPVMQKKTMGWEASSERMYPEDGALKGEIKQRLKLKDGGHYDAEVKTTYKAKKPVQLPGAYNVNIKLDITSHNEDYTIVEQYERAEGRHSTGGMDELYK",
    },
    "mScarlet": {
        "label": "FPbase mScarlet",
        "url": "https://www.fpbase.org/protein/mscarlet/",
        "dna": "ATGGTGAGCAAGGGCGAGGCCGTGATCAAGGAGTTCATGCGCTTCAAGGTGCACATGGAGGGCAGCATGAACGGCCACGAGTTCGAGATCGAGGGCGAGGGCGAGGGCCGCCCCTACGAGGGCACCCAGACCGCCAAGCTGAAGGTGACCAAGGGCGGCCCCCTGCCCTTCAGCTGGGACATCCTGAGCCCCCAGTTCATGTACGGCAGCCGCGCCTTCACCAAGCACCCCGCCGACATCCCCGACTACTACAAGCAGAGCTTCCCCGAGGGCTTCAAGTGGGAGCGCGTGATGAACTTCGAGGACGGCGGCGCCGTGACCGTGACCCAGGACACCAGCCTGGAGGACGGCACCCTGATCTACAAGGTGAAGCTGCGCGGCACCAACTTCCCCCCCGACGGCCCCGTGATGCAGAAGAAGACCATGGGCTGGGAGGCCAGCACCGAGCGCCTGTACCCCGAGGACGGCGTGCTGAAGGGCGACATCAAGATGGCCCTGCGCCTGAAGGACGGCGGCCGCTACCTGGCCGACTTCAAGACCACCTACAAGGCCAAGAAGCCCGTGCAGATGCCCGGCGCCTACAACGTGGACCGCAAGCTGGACATCACCAGCCACAACGAGGACTACACCGTGGTGGAGCAGTACGAGCGCAGCGAGGGCCGCCACAGCACCGGCGGCATGGACGAGCTGTACAAG",
        "aa": "MVSKGEAVIKEFMRFKVHMEGSMNGHEFEIEGEGEGRPYEGTQTAKLKVTKGGPLPFSWDILSPQFMYGSRAFTKHPADIPDYYKQSFPEGFKWERVMNFEDGGAVTVTQDTSLEDGTLIYKVKLRGTNFPPDGPVMQKKTMGWEASTERLYPEDGVLKGDIKMALRLKDGGRYLADFKTTYKAKKPVQMPGAYNVDRKLDITSHNEDYTVVEQYERSEGRHSTGGMDELYK",
    },
    "mScarlet_I3": {
        "label": "FPbase mScarlet-I3",
        "url": "https://www.fpbase.org/protein/mscarlet-i3/",
        "dna": "ATGGATAGCACCGAGGCAGTGATCAAGGAGTTCATGCGGTTCAAGGTGCACATGGAGGGCTCCATGAACGGCCACGAGTTCGAGATCGAGGGCGAGGGCGAGGGCCGCCCCTACGAGGGCACCCAGACCGCCAAGCTGAAGGTGACCAAGGGTGGCCCCCTGCCCTTCTCCTGGGACATCCTGTCCCCTCAGTTCATGTACGGCTCCAGGGCCTTCATCAAGCACCCCGCCGACATCCCCGACTACTGGAAGCAGTCCTTCCCCGAGGGCTTCAAGTGGGAGCGCGTGATGATCTTCGAGGACGGCGGCACCGTGTCCGTGACCCAGGACACCTCCCTGGAGGACGGCACCCTGATCTACAAGGTGAAGCTCCGCGGCGGCAACTTCCCTCCTGACGGCCCCGTAATGCAGAAGAGGACAATGGGCTGGGAAGCATCCACCGAGCGGTTGTACCCCGAGGACGTCGTGCTGAAGGGCGACATTAAGATGGCCCTGCGCCTGAAGGACGGCGGCCGCTACCTGGCGGACTTCAAGACCACCTACAAGGCCAAGAAGCCCGTGCAGATGCCCGGCGCCTTCAACATCGACCGCAAGTTGGACATCACCTCCCACAACGAGGACTACACCGTGGTGGAACAGTACGAACGCTCCGTGGCCCGCCACTCCACCGGCGGCTCCGGTGGCTCC",
        "aa": "MDSTEAVIKEFMRFKVHMEGSMNGHEFEIEGEGEGRPYEGTQTAKLKVTKGGPLPFSWDILSPQFMYGSRAFIKHPADIPDYWKQSFPEGFKWERVMIFEDGGTVSVTQDTSLEDGTLIYKVKLRGGNFPPDGPVMQKRTMGWEASTERLYPEDVVLKGDIKMALRLKDGGRYLADFKTTYKAKKPVQMPGAFNIDRKLDITSHNEDYTVVEQYERSVARHSTGGSGGS",
    },
    "mStayGold2": {
        "label": "FPbase mStayGold2",
        "url": "https://www.fpbase.org/protein/mstaygold2/",
        "dna": "ATGGTGAGCACCGGCGAGGAGCTGTTCACCGGCGTGGTGCCCTTCAAGTTCCAGCTGAAGGGCACCATCAACGGCAAGAGCTTCACCGTGGAGGGCGAGGGCGAGGGCAACAGCCACGAGGGCAGCCACAAGGGCAAGTACGTGTGCACCAGCGGCAAGCTGCCCATGAGCTGGGCCGCCCTGGGCACCAGCTTCGGCTACGGCATGAAGTACTACACCAAGTACCCCAGCGGCCTGAAGAACTGGTTCCACGAGGTGATGCCCGAGGGCTTCACCTACGACCGCCACATCCAGTACAAGGGCGACGGCAGCATCCACGCCAAGCACCAGCACTTCATGAAGAACGGCACCTACCACAACATCGTGGAGTTCACCGGCCAGGACTTCAAGGAGAACAGCCCCGTGCTGACCGGCGACATGGACGTGAGCCTGCCCAACGAGGTGCAGCACATCCCCCGCGACGACGGCGTGGAGTGCACCGTGACCCTGACCTACCCCCTGCTGAGCGACGAGAGCAAGTGCGTGGAGGCCTACCAGAACACCATCATCAAGCCCCTGCACAACCAGCCCGCCCCCGACGTGCCCTACCACTGGATCCGCAAGCAGTACACCCAGAGCAAGGACGACACCGAGGAGCGCGACCACATCATCCAGAGCGAGACCCTGGAGGCCCACCTGTACAGCCGCACCAAGCTGGAG",
        "aa": "MVSTGEELFTGVVPFKFQLKGTINGKSFTVEGEGEGNSHEGSHKGKYVCTSGKLPMSWAALGTSFGYGMKYYTKYPSGLKNWFHEVMPEGFTYDRHIQYKGDGSIHAKHQHFMKNGTYHNIVEFTGQDFKENSPVLTGDMDVSLPNEVQHIPRDDGVECTVTLTYPLLSDESKCVEAYQNTIIKPLHNQPAPDVPYHWIRKQYTQSKDDTEERDHIIQSETLEAHLYSRTKLE",
    },
}

# Sequence modules from which every cassette is put together.
LINKER = "GCAGCTAAAGCCAAAAACAACCAGGGATCCGGA"
P2A = "GCAACAAACTTCTCTCTGCTGAAACAAGCCGGAGATGTCGAAGAGAATCCTGGACCG"
T2A = "GAGGGCAGAGGAAGTCTTCTAACATGCGGCGACGTGGAGGAAAATCCCGGCCCC"
SD40_CORE = "CTGTTGCTGTTCTGCCCTATTTGCGGGTTTACATGTCGCCAGAAGGGCAACTTACTTCGCCATATTAACCTGCACACAGGGGAAAAGTTATTTAAGTACCACCTGTAT"
DTAG_CORE = "GGAGTGCAGGTGGAAACCATCTCCCCAGGAGACGGGCGCACCTTCCCCAAGCGCGGCCAGACCTGCGTGGTGCACTACACCGGGATGCTTGAAGATGGAAAGAAAGTTGATTCCTCCCGGGACAGAAACAAGCCCTTTAAGTTTATGCTAGGCAAGCAGGAGGTGATCCGAGGCTGGGAAGAAGGGGTTGCCCAGATGAGTGTGGGTCAGAGAGCCAAACTGACTATATCTCCAGATTATGCCTATGGTGCCACTGGGCACCCAGGCATCATCCCACCACATGCCACTCTCGTCTTCGATGTGGAGCTTCTAAAACTGGAA"
MAID_CORE = "AAGGAGAAGAGTGCTTGTCCTAAAGATCCAGCCAAACCTCCGGCCAAGGCACAAGTTGTGGGATGGCCACCGGTGAGATCATACCGGAAGAACGTGATGGTTTCCTGCCAAAAATCAAGCGGTGGCCCGGAGGCGGCGGCGTTCGTGAAGGTATCAATGGACGGAGCACCGTACTTGAGGAAAATCGATTTGAGGATGTATAAA"
MINIIAA7_CORE = "GGCTTCTCTGAGACCGTGGACCTGATGCTGAACCTGCAGTCCAATAAGGAGGGCTCTGTGGATCTGAAGAACGTGAGCGCCGTGCCTAAGGAGAAGACCACACTGAAGGACCCATCCAAGCCCCCTGCCAAGGCACAGGTGGTGGGATGGCCACCCGTGCGGAACTACAGAAAGAATATGATGACCCAGCAGAAGACAAGCTCC"
HA_TAG = "TACCCCTACGACGTGCCCGACTACGCC"
V5_TAG = "GGGAAGCCCATCCCCAACCCCCTGCTGGGCCTGGACAGCACG"
TWO_HA_TAIL = "GGCGGCTACCCCTACGACGTGCCCGACTACGCCGGCTATCCGTATGATGTCCCGGACTATGCA"
TWO_HA_ONLY_TAIL = "GGCGGCTACCCCTACGACGTGCCCGACTACGCCGGCTATCCGTATGATGTCCCGGACTAT"
MCHERRY_TAIL = "GTGAGCAAGGGCGAGGAGGATAACATGGCCATCATCAAGGAGTTCATGCGCTTCAAGGTGCACATGGAGGGCTCCGTGAACGGCCACGAGTTCGAGATCGAGGGCGAGGGCGAGGGCCGCCCCTACGAGGGCACCCAGACCGCCAAGCTGAAGGTGACCAAGGGTGGCCCCCTGCCCTTCGCCTGGGACATCCTGTCCCCTCAGTTCATGTACGGCTCCAAGGCCTACGTGAAGCACCCCGCCGACATCCCCGACTACTTGAAGCTGTCCTTCCCCGAGGGCTTCAAGTGGGAGCGCGTGATGAACTTCGAGGACGGCGGCGTGGTGACCGTGACCCAGGACTCCTCCCTGCAGGACGGCGAGTTCATCTACAAGGTGAAGCTGCGCGGCACCAACTTCCCCTCCGACGGCCCCGTAATGCAGAAGAAAACCATGGGCTGGGAGGCCTCCTCCGAGCGGATGTACCCCGAGGACGGCGCCCTGAAGGGCGAGATCAAGCAGAGGCTGAAGCTGAAGGACGGCGGCCACTACGACGCTGAGGTCAAGACCACCTACAAGGCCAAGAAGCCCGTGCAGCTGCCCGGCGCCTACAACGTCAACATCAAGTTGGACATCACCTCCCACAACGAGGACTACACCATCGTGGAACAGTACGAACGCGCCGAGGGCCGCCACTCCACCGGCGGCATGGACGAGCTGTACAAGTAATAA"
P2A_SELECTION = "GGCAGCGGCGCCACCAACTTCAGCCTGCTGAAGCAGGCCGGCGACGTGGAGGAGAACCCCGGCCCC"
BLASTIR_CORE = "ATGAAGACCTTCAACATCTCTCAGCAGGACCTTGAGCTGGTGGAAGTTGCCACTGAGAAAATCACCATGCTCTATGAGGACAACAAGCACCATGTTGGTGCTGCCATCAGGACCAAGACAGGAGAAATCATCTCTGCTGTCCACATTGAAGCCTACATTGGCAGGGTCACTGTGTGTGCAGAGGCCATTGCCATTGGGTCTGCAGTCTCCAATGGGCAGAAGGACTTTGACACCATTGTGGCTGTGAGGCACCCCTACAGTGATGAGGTGGACAGGTCCATCAGAGTGGTGTCCCCCTGTGGCATGTGCAGGGAGCTCATCTCAGACTATGCCCCTGATTGCTTTGTTCTGATTGAGATGAATGGCAAGCTGGTCAAGACAACCATTGAGGAGCTGATTCCACTGAAATACACCAGAAAC"
HYGROR_CORE = "ATGAAAAAGCCTGAACTCACCGCGACGTCTGTCGAGAAGTTTCTGATCGATGCCTGGCGGCGGCGGTGCCGCCGTGCTGGCGATTGCGGAGAGCATCCTGCTGCAACAGCTGCCCGGACGCCGCCCTGTAGAGGAAGAGCCTGACCTATTGCATACTTTGTCAAGAGCAATCGGTCCATCACAGTGCTGACCTCCATAGAAGACACCGCACTGGCTGGAGTTGTCCCAATTCTTGGAGCCCTCAGTCCTGCTCCTCTGGCGATGATTATCATATAATTTCTGGGTAGCGGCTCTGAGGGTGGCGGTGATGCCGGCCACGACGAGATATACAAGCTCCTGAAGTTCATCTGCACCACCGGCAAGCTGCCCGTGCCCTGGCCCACCCTCGTGACCACCCTGACCTACGGCGTGCAGTGCTTCAGCCGCTACCCCGACCACATGAAGCAGCACGACTTCTTCAAGTCCGCCATGCCCGAAGGCTACGTCCAGGAGCGCACCATCTTCTTCAAGGACGACGGCAACTACAAGACCCGCGCCGAGGTGAAGTTCGAGGGCGACACCCTGGTGAACCGCATCGAGCTGAAGGGCATCGACTTCAAGGAGGACGGCAACATCCTGGGGCACAAGCTGGAGTACAACTACAACAGCCACAACGTCTATATCATGGCCGACAAGCAGAAGAACGGCATCAAGGTGAACTTCAAG"
MINIIAA7_CT_SPACER = "GCTAGCGGAGGTGGATCGGGAGGTGGATCG"
MINIIAA7_NT_SPACER = "GGGGGTGGATCGGGAGGTGGATCC"

# Internal tags (DNA, peptide).
INTERNAL_TAGS = {
    "SPOT": ("GACCGCGTGCGCGCCGTGAGCCATTGGAGCAGC", "DRVRAVSHWSS"),
    "alphaBtx": ("CGATACTATGAAAGCAGTCTAGAGCCTTACCCAGAC", "RYYESSLEPYPD"),
}

# The genetic code, codon -> amino acid ('*' is stop).
CODON_TO_AA = {
    "TTT": "F", "TTC": "F", "TTA": "L", "TTG": "L", "TCT": "S", "TCC": "S", "TCA": "S", "TCG": "S", "TAT": "Y",
    "TAC": "Y", "TAA": "*", "TAG": "*", "TGT": "C", "TGC": "C", "TGA": "*", "TGG": "W", "CTT": "L", "CTC": "L",
    "CTA": "L", "CTG": "L", "CCT": "P", "CCC": "P", "CCA": "P", "CCG": "P", "CAT": "H", "CAC": "H", "CAA": "Q",
    "CAG": "Q", "CGT": "R", "CGC": "R", "CGA": "R", "CGG": "R", "ATT": "I", "ATC": "I", "ATA": "I", "ATG": "M",
    "ACT": "T", "ACC": "T", "ACA": "T", "ACG": "T", "AAT": "N", "AAC": "N", "AAA": "K", "AAG": "K", "AGT": "S",
    "AGC": "S", "AGA": "R", "AGG": "R", "GTT": "V", "GTC": "V", "GTA": "V", "GTG": "V", "GCT": "A", "GCC": "A",
    "GCA": "A", "GCG": "A", "GAT": "D", "GAC": "D", "GAA": "E", "GAG": "E", "GGT": "G", "GGC": "G", "GGA": "G",
    "GGG": "G",
}

# Nearest-neighbour stacking parameters, pair -> (dH cal/mol, dS cal/mol/K).
NN_PARAMS = {
    "AA": (-7900, -22.2), "AC": (-8400, -22.4), "AG": (-7800, -21.0), "AT": (-7200, -20.4), "CA": (-8500, -22.7),
    "CC": (-8000, -19.9), "CG": (-10600, -27.2), "CT": (-7800, -21.0), "GA": (-8200, -22.2), "GC": (-9800, -24.4),
    "GG": (-8000, -19.9), "GT": (-8400, -22.4), "TA": (-7200, -21.3), "TC": (-8200, -22.2), "TG": (-8500, -22.7),
    "TT": (-7900, -22.2),
}

# Amplicon sizes and primer limits.
AMP_MIN, AMP_MAX, AMP_WANTED = 450, 500, 475
PRIMER_LEN_MIN, PRIMER_LEN_MAX = 18, 26
PRIMER_TM_MIN, PRIMER_TM_MAX = 55, 67
PRIMER_GC_MIN, PRIMER_GC_MAX = 38, 67
PRIMER_TM_DELTA = 5
PRIMER_PENALTY_MAX = 22
SCREEN_FLANK = 250
LONG_DELETION = 1000
# Guide GC percent below or above which a guide is called atypical.
GUIDE_GC_LOW, GUIDE_GC_HIGH = 30, 80
ICE_OFFSET = 175
DEFAULT_ARM = 250
DEFAULT_TAG = "dTAG-V5"

# Request-text aliases of cassettes (letters and digits only, lower case).
CASSETTE_ALIASES = {
    "mscarlett2a": "T2A-mScarlet_I3", "t2amscarlet": "T2A-mScarlet_I3", "t2amscarleti3": "T2A-mScarlet_I3",
    "mstaygold2t2a": "T2A-mStayGold2", "t2amstaygold2": "T2A-mStayGold2", "mscarletp2a": "P2A-mScarlet",
    "p2amscarlet": "P2A-mScarlet", "mscarleti3p2a": "P2A-mScarlet", "mstaygold2p2a": "P2A-mStayGold2",
    "p2amstaygold2": "P2A-mStayGold2", "egfplinker": "N:EGFP-Linker", "mstaygold2linker": "N:mStayGold2-Linker",
    "sd40linker": "N:SD40-Linker", "dtaglinker": "N:dTAG-Linker", "maidlinker": "N:mAID-Linker",
    "egfpt2a": "T2A-EGFP", "mscarleti3t2a": "T2A-mScarlet_I3", "mcherryp2a": "P2A-mCherry",
}

# Cassettes a request line may name, by terminus.
NT_CASSETTES = [
    "N:EGFP-Linker", "N:mStayGold2-Linker", "T2A-EGFP", "T2A-mScarlet_I3", "T2A-mStayGold2", "P2A-mCherry",
    "P2A-mScarlet", "P2A-mStayGold2", "N:SD40-Linker", "N:dTAG-Linker", "N:mAID-Linker", "N:2xHA-dTAG-Linker",
]
CT_CASSETTES = [
    "2xHA-only", "SD40-2xHA", "dTAG-2xHA", "mAID-2xHA", "T2A-EGFP", "T2A-mScarlet_I3", "T2A-mStayGold2",
    "P2A-mCherry", "P2A-mScarlet", "P2A-mStayGold2", "SD40-2xHA-P2A-mCherry", "dTAG-2xHA-P2A-mCherry",
    "mAID-2xHA-P2A-mCherry",
]

# Reporter name spellings and their order-ready cassettes (N-terminal, C-terminal).
REPORTER_NAMES = {
    "egfp": "EGFP", "mcherry": "mCherry", "mscarlet": "mScarlet", "mscarleti3": "mScarlet_I3",
    "mstaygold2": "mStayGold2",
}
REPORTER_CASSETTES = {
    "EGFP": (["N:EGFP-Linker", "T2A-EGFP"], ["T2A-EGFP"]),
    "mCherry": (["P2A-mCherry"], ["P2A-mCherry"]),
    "mScarlet": (["P2A-mScarlet"], ["P2A-mScarlet"]),
    "mScarlet_I3": (["T2A-mScarlet_I3"], ["T2A-mScarlet_I3"]),
    "mStayGold2": (["N:mStayGold2-Linker", "T2A-mStayGold2", "P2A-mStayGold2"], ["T2A-mStayGold2", "P2A-mStayGold2"]),
}

# Words of a request line that never are a gene symbol.
GENE_STOP_WORDS = [
    "ko", "knockout", "ct", "nt", "cterminal", "nterminal", "cterminus", "nterminus", "c-terminal", "n-terminal",
    "c-terminus", "n-terminus", "c", "n", "term", "terminal", "terminus", "in", "with", "internal", "inframe",
    "after", "make", "design", "create", "add", "insert", "generate", "build", "edit", "tag", "please", "help",
    "want", "need", "show", "draft", "use", "switch", "set", "i", "me", "my", "we", "us", "a", "an", "the", "to",
    "of", "for",
]

# Spellings of edit classes in manifests and in batch definitions.
MANIFEST_EDIT_TYPES = {
    "knockout": "ko", "ko": "ko", "snp knock-in": "pm", "point mutation": "pm", "mutation": "pm", "pm": "pm",
    "n-terminal tag": "nt", "nt": "nt", "c-terminal tag": "ct", "ct": "ct", "internal tag": "it", "it": "it",
}
BATCH_EDIT_TYPES = {
    "pm": ["pm", "snp", "pointmutation", "pointmutations"],
    "ko": ["ko", "knockout", "knockouts"],
    "it": ["it", "internal", "internaltag", "internalinframetag", "inframe", "inframetag", "internalknockin"],
    "ct": ["ct", "cterminal", "ctag", "cterminaltag"],
    "nt": ["nt", "nterminal", "ntag", "nterminaltag"],
}

# Edit class labels of the full and the community edition.
FULL_EDIT_CLASSES = {
    "pm": "Point mutation", "ko": "Knockout", "it": "Internal in-frame tag",
    "ct": "C-terminal tag / reporter", "nt": "N-terminal tag / reporter",
}
COMMUNITY_EDIT_CLASSES = {"pm": "SNP knock-in", "ko": "Knockout"}
COMMUNITY_ONLY_MESSAGE = "Community edition supports knockout or SNP knock-in only."

# Guide-library gene aliases, cell-line alias groups, organism ids by assembly words.
LIBRARY_GENE_ALIASES = {"DIPK2A": "C3ORF58"}
CELL_LINE_ALIASES = {"HMGUI001A": "MDCI053A"}
ORGANISM_RULES = [
    (("grcm", "mm10", "mouse"), "6"), (("rnor", "rat"), "5"), (("grcz", "zebrafish"), "8"), (("sus", "pig"), "12"),
]

# Off-target filter tiers (order, id, label, off-target 0/1/2 limits, max coverage only,
# least out-of-frame score, CDS position range). GC 20-80 and the T-repeat test hold in every tier.
FILTER_TIERS = [
    (1, "strict", "Strict recommended filters", 1, 0, 0, True, 60.0, 5.0, 50.0),
    (2, "balanced", "Balanced fallback filters", 1, 0, 0, False, 40.0, 5.0, 80.0),
    (3, "broad", "Broad fallback filters", None, None, None, False, None, None, None),
]

# Texts of the two reference guide sources.
LIBRARY_SOURCE = "Broad GPP Brunello human CRISPRko library"
LIBRARY_NONE_NOTE = "No Brunello reference guides were found for this gene symbol."
TARGETS_NO_GENE_NOTE = "No Cas-Database gene match was found for this query and organism."
TARGETS_NONE_NOTE = "Cas-Database found the gene, but no targets matched the available filter tiers."
TARGETS_STRICT_NOTE = "Showing the top 3 guides from the default recommended Cas-Database knockout filters."

# Columns of the order sheet, in order.
ORDER_HEADERS = [
    "Slot", "Design", "Gene", "Design Type", "Reference File", "Item Type", "Name", "Sequence To Order", "Spacer",
    "PAM", "Strand", "Length", "Linked Guide", "Recommended", "Notes",
]
