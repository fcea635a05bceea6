"""Vocabularies and patterns.

Fixed values: results depend on these lists entry by entry, so they stand here as they are, in
their own order. Every operator takes its vocabulary as a parameter; these are the defaults.
"""

# Toxin, kinetics and unit keywords of the paper pre-check. They are patterns, not
# escaped text.
TOXIN_KEYWORDS = (
    "aflatoxin", "afb1", "afb2", "afg1", "afg2", "afm1", "afm2", "aflatoxicol",
    "ochratoxin", "ota", "otb", "otc",
    "deoxynivalenol", "don", "nivalenol", "niv", "t-2", "ht-2", "3-adon", "15-adon", "das",
    "fumonisin", "fb1", "fb2", "fb3",
    "zearalenone", "zen", "α-zel", "β-zel", "alpha-zearalenol", "beta-zearalenol",
    "patulin", "citrinin", "sterigmatocystin", "cyclopiazonic acid", "cpa", "alternariol", "aoh",
)
KINETICS_KEYWORDS = (
    "km", "kcat", "kcat/km", "vmax", "ic50", "ki", "km_value", "kcat_value", "kcat_km_value",
    "michaelis", "menten", "turnover",
    "enzyme activity", "specific activity", "enzyme assay", "enzymatic assay",
    "degradation", "degrade", "degraded", "detoxification", "detoxify", "biotransformation", "transform",
    "metabolite", "product", "degradation product",
)
UNIT_KEYWORDS = (
    "μm", "um", "mm", "nm", "µm", "s⁻¹", "s^-1", "min⁻¹", "min^-1", "μmol", "umol", "nmol", "unit/ml", "u/ml", "iu",
)

# Block filter.
REFERENCE_TITLES = (
    r"^references?\s*$", r"^bibliography\s*$", r"^literature\s+cited\s*$", r"^works\s+cited\s*$", r"^citations?\s*$",
)
REFERENCE_ENTRIES = (
    r"doi:\s*10\.\d{4,}", r"https?://doi\.org/", r"\(\d{4}\)\.", r"et\s+al\.\s*\(\d{4}\)", r"^\s*\[\d+\]",
    r"^\s*\d+\.\s+\w+,\s+\w+\..*\(\d{4}\)",
)
NON_DATA_HEADERS = (
    r"^abstract\s*$", r"^keywords?\s*$", r"^acknowledgments?\s*$", r"^funding\s*$", r"^conflict\s+of\s+interest",
    r"^author\s+contributions?", r"^copyright", r"^©\s*\d{4}", r"^received:.*accepted:",
)
DATA_KEYWORDS = (
    "km", "vmax", "kcat", "ki", "ic50", "enzyme", "kinetic", "activity", "degradation", "mycotoxin", "aflatoxin",
    "substrate", "product", "reaction", "temperature", "ph", "optimal", "μm", "mm", "nm", "µm", "min⁻¹", "s⁻¹", "h⁻¹",
)

# Quality constraints.
TOXIN_SUBSTRATES = (
    "aflatoxin b1", "aflatoxin b2", "aflatoxin g1", "aflatoxin g2", "aflatoxin m1", "aflatoxin m2", "aflatoxin p1",
    "afb1", "afb2", "afg1", "afg2", "afm1", "afm2", "afp1",
    "ochratoxin a", "ochratoxin b", "ochratoxin c", "ota", "otb", "otc",
    "deoxynivalenol", "nivalenol", "t-2 toxin", "ht-2 toxin", "3-acetyldeoxynivalenol", "15-acetyldeoxynivalenol",
    "diacetoxyscirpenol", "don", "niv", "t-2", "ht-2", "3-adon", "15-adon", "das",
    "fumonisin b1", "fumonisin b2", "fumonisin b3", "hydrolyzed fumonisin b1", "fb1", "fb2", "fb3", "hfb1",
    "zearalenone", "alpha-zearalenol", "beta-zearalenol", "zen", "zea", "α-zel", "β-zel", "α-zol", "β-zol",
    "patulin", "citrinin", "sterigmatocystin", "cyclopiazonic acid", "roquefortine c", "mycophenolic acid",
    "alternariol", "alternariol monomethyl ether", "tenuazonic acid", "moniliformin", "beauvericin",
    "pat", "cit", "ste", "st", "cpa", "roq-c", "mpa", "aoh", "ame", "tea", "mon", "bea",
    "enniatin", "enniatin a", "enniatin b", "enniatin b1", "enn", "enna", "ennb", "ennb1",
    "ergotamine", "ergocristine", "ergocryptine",
)
NON_TOXIN_SUBSTRATES = (
    "abts", "2,2'-azino-bis(3-ethylbenzothiazoline-6-sulfonic acid)", "syringaldazine", "sgz",
    "2,6-dimethoxyphenol", "dmp", "guaiacol", "catechol", "hydroquinone", "veratryl alcohol",
    "remazol brilliant blue r", "rbbr", "reactive black 5", "rb5", "methylene blue", "malachite green",
    "congo red", "bromophenol blue",
    "hydrogen peroxide", "h2o2", "h₂o₂", "manganese", "mn2+", "mn(ii)", "phenol", "aniline", "benzene",
)
CRUDE_KEYWORDS = (
    "crude extract", "crude enzyme", "cell lysate", "lysate", "culture supernatant", "supernatant",
    "fermentation broth", "partially purified", "commercial", "commercial preparation", "enzyme cocktail",
    "enzyme mixture", "mixed enzymes", "fungal extract", "bacterial extract", "microbial extract",
    "sigma", "sigma-aldrich", "novozyme", "novozymes",
)
BIOACTIVATION_KEYWORDS = (
    "bioactivation", "activated", "activation", "more toxic", "increased toxicity", "enhanced toxicity",
    "potentiated toxicity", "toxic metabolite", "carcinogenic", "mutagenic metabolite", "epoxide", "afbo",
)
DETOX_KEYWORDS = (
    "detoxification", "detoxified", "less toxic", "reduced toxicity", "decreased toxicity", "non-toxic", "nontoxic",
    "non toxic", "non-mutagenic", "decreased cytotoxicity", "reduced cytotoxicity", "loss of toxicity", "detoxify",
    "degradation",
)

# Substrates that the last filter knows.
KNOWN_SUBSTRATES = (
    "aflatoxin b1", "aflatoxin b2", "aflatoxin g1", "aflatoxin g2", "afb1", "afb2", "afg1", "afg2",
    "aflatoxin m1", "aflatoxin m2", "afm1", "afm2",
    "ochratoxin a", "ochratoxin b", "ota", "otb",
    "deoxynivalenol", "don", "nivalenol", "niv", "t-2 toxin", "t-2", "ht-2 toxin", "ht-2",
    "3-acetyldeoxynivalenol", "3-adon", "15-acetyldeoxynivalenol", "15-adon", "diacetoxyscirpenol", "das",
    "fumonisin b1", "fumonisin b2", "fumonisin b3", "fb1", "fb2", "fb3", "hydrolyzed fumonisin b1", "hfb1",
    "zearalenone", "zen", "zea", "alpha-zearalenol", "α-zearalenol", "α-zel", "alpha-zel",
    "beta-zearalenol", "β-zearalenol", "β-zel", "beta-zel",
    "patulin", "citrinin", "sterigmatocystin", "cyclopiazonic acid", "cpa",
    "alternariol", "aoh", "alternariol monomethyl ether", "ame", "tenuazonic acid", "tea",
    "moniliformin", "beauvericin", "enniatin",
)

# Tables.
CAPTION_EXCLUDE = (
    "pdb", "accession", "uniprot", "genbank", "primer", "sequence", "gene ontology", "go term", "pathway", "network",
    "interaction", "binding site", "alignment", "homology", "phylogenetic", "blast",
)
KINETIC_HEADERS = (
    "km", "k_m", "kcat", "k_cat", "kcat/km", "turnover", "catalytic", "vmax", "velocity", "degradation",
    "detoxification", "efficiency", "activity", "substrate", "michaelis", "kinetic", "enzyme", "mycotoxin",
    "aflatoxin", "ochratoxin", "deoxynivalenol", "zearalenone",
)

# Text cleaning. Patterns in the order in which they are tried.
REFERENCE_HEADERS = (
    r"\n\s*REFERENCES?\s*\n", r"\n\s*References?\s*\n", r"\n\s*Bibliography\s*\n", r"\n\s*BIBLIOGRAPHY\s*\n",
    r"\n\s*Literature Cited\s*\n", r"\n\s*Works Cited\s*\n", r"\n\s*\d+\.?\s*REFERENCES?\s*\n",
    r"\n\s*\d+\.?\s*References?\s*\n",
)
REFERENCE_LINE = r"^\s*[\[\(]?\d+[\]\)\.]\s+[A-Z][a-z]+"
MARKDOWN_REFERENCE_HEADERS = (
    r"\nReferences\s*\n", r"\nReferences\s*$", r"\n参考文献\s*\n", r"\nREFERENCES\s*\n", r"\nReferences\s*\r?\n",
)
PAPER_REFERENCES = (
    (r"\*\{.{0,5}(References|Reference|REFERENCES|LITERATURE CITED|Referencesand notes|Notes and references)(.*?)\\section\*\{Tables", "\\\\section*{Tables\n"),
    (r"#.{0,15}(References|Reference|REFERENCES|LITERATURE CITED|Referencesand notes|Notes and references)(.*?)(Table|Tables)", "Tables"),
    (r"#.{0,15}(References|Reference|REFERENCES|LITERATURE CITED|Referencesand notes|Notes and references)(.*?)# SUPPLEMENTARY", "# SUPPLEMENTARY"),
    (r"#{1,3}\s*(References|Reference|REFERENCES|LITERATURE CITED|Bibliography|Works Cited).*", ""),
    (r"\\section\*?\{(References|Reference|REFERENCES|Bibliography)\}.*", ""),
    (r"\*\{.{0,5}(References|Reference|REFERENCES|LITERATURE CITED|Referencesand notes|Notes and references).*", ""),
    (r"\n(References|Reference|REFERENCES|LITERATURE CITED|Bibliography)\n.*", ""),
)
INTRODUCTION_HEADERS = (
    r"\n\s*INTRODUCTION\s*\n", r"\n\s*Introduction\s*\n", r"\n\s*1\.?\s*INTRODUCTION\s*\n",
    r"\n\s*1\.?\s*Introduction\s*\n", r"\n\s*I\.?\s*INTRODUCTION\s*\n", r"\n\s*I\.?\s*Introduction\s*\n",
)
INTRODUCTION_ENDS = (
    r"\n\s*(?:MATERIALS?\s+AND\s+)?METHODS?\s*\n", r"\n\s*(?:Materials?\s+and\s+)?Methods?\s*\n",
    r"\n\s*RESULTS?\s*\n", r"\n\s*Results?\s*\n", r"\n\s*EXPERIMENTAL\s*\n", r"\n\s*Experimental\s*\n",
    r"\n\s*\d+\.?\s*(?:MATERIALS?\s+AND\s+)?METHODS?\s*\n", r"\n\s*\d+\.?\s*(?:Materials?\s+and\s+)?Methods?\s*\n",
    r"\n\s*\d+\.?\s*RESULTS?\s*\n", r"\n\s*\d+\.?\s*Results?\s*\n",
)
LATEX_UNITS = (
    (r"\\mu\\mathrm\s*\{\s*M\s*\}", "μM"), (r"\\mu\s*M", "μM"), (r"\\mathrm\s*\{\s*m\s*M\s*\}", "mM"),
    (r"\\mathrm\s*\{\s*M\s*\}", "M"), (r"\\mathrm\s*\{\s*s\s*\}", "s"), (r"\\mathrm\s*\{\s*min\s*\}", "min"),
    (r"\\mathrm\s*\{\s*h\s*\}", "h"), (r"\^\s*\{\s*-\s*1\s*\}", "⁻¹"), (r"\^\s*\{\s*\\circ\s*\}", "°"),
    (r"\\mathrm\s*\{\s*~\s*C\s*~\s*\}", "°C"), (r"\\mathrm\s*\{\s*p\s*H\s*~\s*\}", "pH "),
)
BIO_PATTERNS = (
    r"(?:ATCC|MTCC|NRRL|DSM|JCM|KCTC|CGMCC|CECT|NBRC|IFO|CBS|NCIMB|LMG)\s*\d+",
    r"(?:NC_|NZ_|NP_|WP_|YP_|XP_)\d+(?:\.\d+)?", r"\b[A-Z]{3}\d{5,7}(?:\.\d+)?\b", r"\b[A-Z][0-9][A-Z0-9]{3}[0-9]\b",
    r"\b[A-Z][0-9][A-Z0-9]{3}[0-9]_[A-Z0-9]+\b", r"\b\d[A-Z0-9]{3}\b", r"EC\s*[\d\.\-]+", r"\b\d+\.\d+\.\d+\.\d+\b",
    r"\b\d+(?:\.\d+)?\s*k?Da\b", r"\b\d+\s*bp\b", r"\b\d+\s*aa\b", "5['’]-[ATCG]{15,}-3['’]",
    r"(?:forward|reverse|primer)[^.]{0,50}[ATCG]{15,}", r"\b(?:gene|protein|enzyme)\s+\w+",
    r"(?:pET|pGEX|pMAL|pQE|expression\s+vector)", r"(?:strain|isolate)\s+\w+", r"(?:obtained|purchased)\s+from",
    r"(?:sequence|cloning|PCR|amplif)", r"(?:SDS-PAGE|gel\s+electrophoresis)",
)

BIO_SECTIONS = (
    "materials and methods", "methods", "materials", "experimental", "strains", "cloning", "expression",
    "purification", "characterization", "sequence",
)

# Names.
TAGS = (
    r"^(His\d+)-", r"^(\d+xHis)-", r"^(His)-", r"^(GST|MBP|SUMO|Trx|NusA|DsbA)-",
    r"^(Thioredoxin|Maltose[_\s]?binding)-", r"^(FLAG|Strep|StrepII|StrepTag|SBP)-",
    r"^(GFP|EGFP|mCherry|RFP|YFP|CFP|BFP)-", r"^(HA|Myc|V5|T7|S)-", r"-(His\d+)$", r"-(\d+xHis)$", r"-(His)$",
    r"-(GFP|EGFP|mCherry|RFP|YFP|CFP)$", r"-(HA|Myc|V5|FLAG)$",
)
GENERA = {
    "b": "Bacillus", "e": "Escherichia", "s": "Saccharomyces", "p": "Pseudomonas", "a": "Aspergillus",
    "t": "Trametes", "c": "Candida", "k": "Kluyveromyces", "l": "Lactobacillus", "m": "Mycobacterium",
    "r": "Rhizopus", "f": "Fusarium", "n": "Neurospora", "y": "Yarrowia",
}
COMPOUND_ALIASES = {
    "afb1": "Aflatoxin B1", "afb₁": "Aflatoxin B1", "afb2": "Aflatoxin B2", "afb₂": "Aflatoxin B2",
    "afg1": "Aflatoxin G1", "afg₁": "Aflatoxin G1", "afg2": "Aflatoxin G2", "afg₂": "Aflatoxin G2",
    "afm1": "Aflatoxin M1", "afm₁": "Aflatoxin M1", "afm2": "Aflatoxin M2", "afp1": "Aflatoxin P1",
    "ota": "Ochratoxin A", "otb": "Ochratoxin B", "don": "Deoxynivalenol", "3-adon": "3-Acetyldeoxynivalenol",
    "15-adon": "15-Acetyldeoxynivalenol", "niv": "Nivalenol", "t-2": "T-2 toxin", "t2": "T-2 toxin",
    "ht-2": "HT-2 toxin", "ht2": "HT-2 toxin", "das": "Diacetoxyscirpenol", "zea": "Zearalenone", "zen": "Zearalenone",
    "α-zol": "alpha-Zearalenol", "alpha-zol": "alpha-Zearalenol", "β-zol": "beta-Zearalenol",
    "beta-zol": "beta-Zearalenol", "α-zel": "alpha-Zearalenol", "β-zel": "beta-Zearalenol",
    "fb1": "Fumonisin B1", "fb₁": "Fumonisin B1", "fb2": "Fumonisin B2", "fb₂": "Fumonisin B2", "fb3": "Fumonisin B3",
    "hfb1": "Hydrolyzed fumonisin B1", "pat": "Patulin", "cit": "Citrinin", "ste": "Sterigmatocystin",
    "st": "Sterigmatocystin", "cpa": "Cyclopiazonic acid", "roq-c": "Roquefortine C", "mpa": "Mycophenolic acid",
    "aoh": "Alternariol", "ame": "Alternariol monomethyl ether", "tea": "Tenuazonic acid", "mon": "Moniliformin",
    "bea": "Beauvericin", "enna": "Enniatin A", "ennb": "Enniatin B",
    "abts": "2,2'-azino-bis(3-ethylbenzothiazoline-6-sulfonic acid)", "sgz": "Syringaldazine",
    "dmp": "2,6-Dimethoxyphenol", "guaiacol": "Guaiacol", "catechol": "Catechol", "hydroquinone": "Hydroquinone",
    "veratryl alcohol": "Veratryl alcohol", "rbbr": "Remazol Brilliant Blue R", "rb5": "Reactive Black 5",
    "p-np": "4-Nitrophenol", "pnp": "4-Nitrophenol", "p-npp": "4-Nitrophenyl phosphate",
}

# Prices of a million tokens (input, output, currency) by client.
PRICES = {
    "openai": (0.0, 0.0, "USD"), "gpt5client": (0.0, 0.0, "USD"), "deepseekclient": (0.0, 0.0, "USD"),
    "moonshotclient": (0.0, 0.0, "CNY"), "zhipuaiclient": (0.4, 0.8, "CNY"), "anthropicclient": (0.0, 0.0, "USD"),
    "geminiclient": (0.0, 0.0, "USD"), "ollamaclient": (0.0, 0.0, "LOCAL"),
}

# Units and ranges that a merged record is checked against.
ALLOWED_UNITS = {
    "Km": ("μM", "mM", "nM", "M", "uM", "µM"),
    "kcat": ("s⁻¹", "s-1", "min⁻¹", "min-1", "s^-1", "min^-1", "/s", "/min"),
    "Vmax": ("μM/min", "mM/min", "nmol/min/mg", "μmol/min/mg", "U/mg", "umol/min", "nmol/min", "μmol/min"),
    "kcat_Km": (
        "M⁻¹s⁻¹", "M-1s-1", "mM⁻¹s⁻¹", "mM-1s-1", "M^-1s^-1", "mM^-1s^-1", "/M/s", "/mM/s", "M⁻¹ min⁻¹", "M-1min-1",
        "mM⁻¹ min⁻¹", "mM-1min-1", "M^-1min^-1", "mM^-1min^-1", "/M/min", "/mM/min",
    ),
}
RANGES = {"Km": (1e-6, 1000.0), "kcat": (1e-3, 1e4), "Vmax": (1e-3, 1e4), "kcat_Km": (1e-3, 1e9)}
FOLD_KEYWORDS = ("fold", "times", "increase", "higher than", "×", "x")
