"""Lookup tables. All are bounded by this file, so any of them may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pairs(text: str) -> dict[str, str]:
    """{alias: value} of lines 'value: alias, alias'."""
    return {a.strip(): k.strip() for k, v in (line.split(":", 1) for line in text.strip().splitlines()) for a in v.split(",")}


def _lists(text: str) -> dict[str, tuple[str, ...]]:
    return {k.strip(): tuple(a.strip() for a in v.split(",")) for k, v in (line.split(":", 1) for line in text.strip().splitlines())}


#: Names of extracted fields, by canonical field.
FIELD_OF = _pairs("""
species: species, organism
organ: tissue, organ
cell_type: cell_type, celltype, cell type
cell_line: cell_line, cellline, cell line
disease: disease_state, disease
sex: sex
age: age
developmental_stage: developmental_stage
ethnicity: ethnicity, ancestrycategory
material_type: material_type, materialtype
strain: strain
BMI: BMI, bmi
instrument: instrument
cleavage_agent: cleavage agent, cleavage_agent
label: labeling, labelling, label
fragmentation: fragmentation method, fragmentation_method, fragmentation
precursor_tolerance: precursor_tolerance, precursor tolerance
fragment_tolerance: fragment_tolerance, fragment tolerance
collision_energy: collision energy, collision_energy
mass_analyzer: mass_analyzer, mass analyzer, ms2massanalyzer
ptm: ptm, modification, post_translational_modification
acquisition_method: acquisition method, acquisition_method
enrichment_method: enrichment method, enrichment_method
fractionation: fractionation method, fractionation_method
ionization: ionization type, ionization_type
reduction_reagent: reduction reagent, reduction_reagent
alkylation_reagent: alkylation reagent, alkylation_reagent
flow_rate: flow_rate, flow rate
gradient_time: gradient_time, gradient time
chromatography: chromatography
replicates: biological_replicate, number_of_biological_replicates, replicates
technical_replicates: technical_replicate, number_of_technical_replicates
fractions: number_of_fractions, fractions
factor_value: factor_value
experimental_design: experimental_design
technology_type: technology_type
number_of_samples: number_of_samples
missed_cleavages: missed_cleavages
""")

#: Headers of sample tables (letters alone), by canonical field.
FIELD_OF_HEADER = _pairs("""
species: organism
organ: organismpart
cell_type: celltype
cell_line: cellline
disease: disease
sex: sex
age: age
developmental_stage: developmentalstage
ethnicity: ancestrycategory
material_type: materialtype
instrument: instrument
cleavage_agent: cleavageagent
label: label
fragmentation: fragmentationmethod
precursor_tolerance: precursormasstolerance
fragment_tolerance: fragmentmasstolerance
collision_energy: collisionenergy
mass_analyzer: ms2massanalyzer
technology_type: technologytype
""")

#: Keys of annotations, by agent and canonical field.
ANNOTATION_FIELDS = {
    "BiologicalAgent": _pairs("""
species: Organism
organ: OrganismPart
cell_type: CellType
cell_line: CellLine
disease: Disease
sex: Sex
age: Age
developmental_stage: DevelopmentalStage
ethnicity: AncestryCategory
material_type: MaterialType
strain: Strain
BMI: BMI
"""),
    "TechnicalAgent": _pairs("""
cleavage_agent: CleavageAgent
label: Label
ptm: Modification
instrument: Instrument
reduction_reagent: ReductionReagent
"""),
    "ExperimentalDesignAgent": _pairs("""
replicates: NumberOfBiologicalReplicates
technical_replicates: NumberOfTechnicalReplicates
number_of_samples: NumberOfSamples
"""),
}

#: Entity types of fields, and the fields' ontologies for matching by hierarchy.
ENTITY_OF = _pairs("""
species: species, organism
cell_type: cell_type
cell_line: cell_line
tissue: tissue, organ
disease: disease, disease_state
instrument: instrument
labelling: labelling, label
modification: modification, ptm
fractionation: fractionation
sample_source: sample_source
""")
HIERARCHY_OF = {"cell_type": "cl", "organ": "uberon", "disease": "mondo"}

#: Fields of each agent, and fields that papers don't state.
AGENT_FIELDS = _lists("""
BiologicalAgent: species, organism, tissue, organ, cell_type, cell_line, disease, disease_state, age, BMI, sex, strain, sample_source
TechnicalAgent: instrument, detector, source, analyzer, chromatography, column, injection_volume, flow_rate, gradient, solvent_A, solvent_B, MS1_range, MS2_range, fragmentation, precursor_selection, resolution, software, database, processing_parameters, ptm, modification
ExperimentalDesignAgent: experiment_type, experimental_design, control_group, treatment_group, replicates, time_points, quantification_method, statistical_test, software_used
""")
METADATA_ONLY = tuple("age sex ethnicity developmental_stage material_type technology_type precursor_tolerance fragment_tolerance mass_analyzer ptm".split())

#: Other names that a golden field's value may stand under, in order.
ALTERNATIVES = _lists("""
replicates: number_of_biological_replicates, number_of_technical_replicates, biological_replicate, technical_replicate
number_of_replicates: number_of_biological_replicates, number_of_technical_replicates
missed_cleavages: missed_cleavage, max_missed_cleavages
cleavage_agent: cleavage_reagent, protease, enzyme
fragmentation: fragmentation_method, fragmentation_type
ionization: ionization_type, ionization_mode
instrument: mass_spectrometer, instrument_model
label: labeling, labeling_method, quantification_method
ptm: modification, variable_modification, fixed_modification
precursor_tolerance: precursor_mass_tolerance, ms1_tolerance
reduction_reagent: reducing_agent, reduction_agent
strain: cell_line, strain_name
material_type: sample_type, material
""")

#: Cell types of cell lines.
CELL_TYPE_OF_LINE = _pairs("""
epithelial cell: hela, mcf-7, mcf7, mda-mb-231, a549, hct116, caco-2, caco2, pc-3, pc3, lncap, vero, vero e6, hek293, hek-293, 293t, hek293t, panc-1, bxpc-3
T cell: jurkat
myeloid cell: k562
monocyte: thp-1, thp1, u937
macrophage: raw264.7, raw 264.7
neuron: sh-sy5y, shsy5y, neuro2a, n2a
fibroblast: nih3t3, nih-3t3, mef, wi-38, 3t3-l1
myoblast: c2c12
osteoblast: u2os, saos-2
hepatocyte: hepg2, hep-g2, huh-7, huh7
melanocyte: a375, b16
embryonic stem cell: h9, h1
""")

#: Identifier prefixes of ontologies and of entity types, and modification aliases.
PREFIXES = {"bto": "BTO:", "cl": "CL:", "clo": "CLO:", "doid": "DOID:", "mondo": "MONDO:", "pride-cv": "PRIDE:", "psi-ms": "MS:", "psimod": "MOD:", "species": "NCBITaxon:", "uberon": "UBERON:", "unimod": "UNIMOD:"}
ENTITY_PREFIXES = _lists("""
species: NCBITaxon
organism: NCBITaxon
cell_type: CL
cell_line: CLO
tissue: UBERON
organ: UBERON
sample_source: BTO
disease: MONDO
disease_state: MONDO
instrument: MS
labelling: MS
fractionation: MS
modification: MOD, UNIMOD
ptm: MOD, UNIMOD
""")
MODIFICATION_ALIASES = {"acetylation": "acetyl", "carbamidomethylation": "carbamidomethyl", "oxidized": "oxidation", "phosphorylation": "phospho"}

#: Names of species by taxon.
TAXON_NAMES = _lists("""
9606: homo sapiens, human, h. sapiens, h sapiens
10090: mus musculus, mouse, m. musculus, m musculus
10116: rattus norvegicus, rat, r. norvegicus
9544: macaca mulatta, rhesus macaque, rhesus monkey
9031: gallus gallus, chicken
7227: drosophila melanogaster, fruit fly, drosophila
6239: caenorhabditis elegans, c. elegans, worm
3702: arabidopsis thaliana, thale cress, arabidopsis
4932: saccharomyces cerevisiae, yeast, s. cerevisiae
562: escherichia coli, e. coli
9913: bos taurus, cow, bovine, cattle
9823: sus scrofa, pig, swine, porcine
9615: canis lupus familiaris, dog, canine
9986: oryctolagus cuniculus, rabbit
""")

#: Taxa whose lineage holds vertebrates (7742) and animals (33208), and those of other lineages.
VERTEBRATES = "9606 10090 10116 9913 9823 9031 7955 9544 9598 9541 9615 9685 9986 9940 9796 9825 8355".split()
LINEAGE = {f"NCBITaxon:{t}": (f"NCBITaxon:{t}", "NCBITaxon:7742", "NCBITaxon:33208") for t in VERTEBRATES} | {
    "NCBITaxon:7227": ("NCBITaxon:7227", "NCBITaxon:50557", "NCBITaxon:33208"),
    "NCBITaxon:6239": ("NCBITaxon:6239", "NCBITaxon:33208"),
}

#: Body fluids, and classes of tissues.
BODY_FLUIDS = tuple(
    "blood, blood plasma, blood serum, plasma, serum, urine, cerebrospinal fluid, saliva, tear fluid, tears, sweat, milk, sputum, cervicovaginal fluid, seminal fluid, semen, sperm, "
    "synovial fluid, bronchoalveolar lavage fluid, amniotic fluid, bile, ascites, pleural fluid, lymph, exosome, extracellular vesicle".split(", ")
)
TISSUE_CLASS = _pairs("""
Thyroid: thyroid gland, thyroid
Brain: brain, cerebral cortex, prefrontal cortex, frontal lobe, temporal lobe, cortex
Liver: liver
Lung: lung
Heart: heart
Kidney: kidney, cortex of kidney
Colon: colon
Rectum: rectum
Stomach: stomach
Duodenum: duodenum
Small intestine: small intestine
Esophagus: esophagus
Spleen: spleen
Lymph node: lymph node
Tonsil: tonsil
Appendix: vermiform appendix, appendix
Testis: testis
Ovary: ovary
Prostate: prostate, prostate gland
Placenta: placenta
Endometrium: uterine endometrium, endometrium
Oviduct: fallopian tube, oviduct
Urinary bladder: urinary bladder
Adrenal gland: adrenal gland
Pituitary gland: pituitary gland, hypophysis
Salivary gland: salivary gland, saliva-secreting gland
Parotid gland: parotid gland
Skeletal muscle: skeletal muscle, skeletal muscle tissue, muscle
Smooth muscle: smooth muscle
Adipose tissue: adipose tissue, subcutaneous fat
Bone marrow: bone marrow
Monocytes: monocytes, monocyte
B-cells: b cells, b-cells, b cell
Nasal Polyps: nasal polyps
""")


def frame(spark: SparkSession, table: dict, columns: str) -> DataFrame:
    """A table as rows (key, value), a row for each of several values."""
    rows = [(k, x) for k, v in table.items() for x in (v if isinstance(v, tuple) else (v,))]
    return spark.createDataFrame(rows, columns)

#: Words of run names by field, in the order of precedence: canonical name, how it is matched, word.
#: "words": words of the name written together in lower case; "as written": with their capitals; "anywhere": within a word too.
RUN_WORDS = {
    "instrument": [
        ("Orbitrap Exploris 480", "words", "exploris480"),
        ("Orbitrap Exploris 480", "words", "orbitrapexploris480"),
        ("Orbitrap Exploris 240", "words", "exploris240"),
        ("Orbitrap Exploris 240", "words", "orbitrapexploris240"),
        ("Orbitrap Exploris 120", "words", "exploris120"),
        ("Orbitrap Exploris 120", "words", "orbitrapexploris120"),
        ("Orbitrap Exploris 480", "words", "exploris"),
        ("Orbitrap Exploris 480", "words", "orbitrapexploris"),
        ("Orbitrap Exploris 480", "words", "expl"),
        ("Q Exactive HF-X", "words", "qexactivehfx"),
        ("Q Exactive HF-X", "words", "qehfx"),
        ("Q Exactive HF-X", "words", "hfx"),
        ("Q Exactive HF", "words", "qexactivehf"),
        ("Q Exactive HF", "words", "qexhf"),
        ("Q Exactive HF", "words", "qehf"),
        ("Q Exactive Plus", "words", "qexactiveplus"),
        ("Q Exactive Plus", "words", "qexplus"),
        ("Q Exactive Plus", "words", "qeplus"),
        ("Q Exactive Plus", "words", "qep"),
        ("Q Exactive", "words", "qexactive"),
        ("Q Exactive", "words", "qexac"),
        ("Q Exactive", "words", "qe"),
        ("Orbitrap Eclipse", "words", "eclipse"),
        ("Orbitrap Eclipse", "words", "orbitrapeclipse"),
        ("Orbitrap Fusion Lumos", "words", "fusionlumos"),
        ("Orbitrap Fusion Lumos", "words", "orbitrapfusionlumos"),
        ("Orbitrap Fusion Lumos", "words", "lumos"),
        ("Orbitrap Fusion", "words", "fusion"),
        ("Orbitrap Fusion", "words", "orbitrapfusion"),
        ("Orbitrap Elite", "words", "orbitrapelite"),
        ("Orbitrap Elite", "words", "ltqorbitrapelite"),
        ("LTQ Orbitrap Velos", "words", "orbitrapvelos"),
        ("LTQ Orbitrap Velos", "words", "ltqorbitrapvelos"),
        ("LTQ Orbitrap XL", "words", "orbitrapxl"),
        ("LTQ Orbitrap XL", "words", "ltqorbitrapxl"),
        ("Orbitrap Astral", "words", "orbitrapastral"),
        ("Orbitrap", "words", "orbi"),
        ("LTQ Velos", "words", "ltqvelos"),
        ("LTQ Velos", "words", "velos"),
        ("timsTOF Ultra", "words", "timstofultra"),
        ("timsTOF SCP", "words", "timstofscp"),
        ("timsTOF HT", "words", "timstofht"),
        ("timsTOF Pro", "words", "timstofpro"),
        ("timsTOF Pro", "words", "timstof"),
        ("TripleTOF 6600", "words", "tripletof6600"),
        ("TripleTOF 5600", "words", "tripletof5600"),
        ("ZenoTOF 7600", "words", "zenotof7600"),
        ("maXis", "as written", "maXis"),
        ("impact II", "words", "impactii"),
        ("Synapt G2-Si", "words", "synapt"),
    ],
    "acquisition": [
        ("DDA", "as written", "DDA"),
        ("DIA", "as written", "DIA"),
    ],
    "labeling": [
        ("TMT", "as written", "TMT"),
        ("iTRAQ", "words", "itraq"),
        ("iTRAQ", "words", "itraqplex"),
        ("SILAC", "as written", "SILAC"),
    ],
    "fragmentation": [
        ("EThcD", "words", "ethcd"),
        ("ETD", "as written", "ETD"),
        ("HCD", "as written", "HCD"),
        ("CID", "as written", "CID"),
        ("UVPD", "as written", "UVPD"),
    ],
    "organism": [
        ("Homo sapiens", "anywhere", "homosapiens"),
        ("Homo sapiens", "anywhere", "homo_sapiens"),
        ("Homo sapiens", "anywhere", "human"),
        ("Mus musculus", "words", "musmusculus"),
        ("Mus musculus", "words", "mouse"),
        ("Rattus norvegicus", "words", "rattusnorvegicus"),
        ("Rattus norvegicus", "words", "rat"),
        ("Danio rerio", "words", "daniorerio"),
        ("Danio rerio", "words", "zebrafish"),
        ("Drosophila melanogaster", "words", "drosophila"),
        ("Drosophila melanogaster", "words", "fly"),
        ("Caenorhabditis elegans", "words", "celegans"),
        ("Caenorhabditis elegans", "words", "worm"),
        ("Saccharomyces cerevisiae", "words", "scerevisiae"),
        ("Saccharomyces cerevisiae", "words", "yeast"),
        ("Escherichia coli", "words", "ecoli"),
        ("Arabidopsis thaliana", "words", "arabidopsis"),
    ],
    "tissue": [
        ("brain", "words", "brain"),
        ("heart", "words", "heart"),
        ("liver", "words", "liver"),
        ("lung", "words", "lung"),
        ("kidney", "words", "kidney"),
        ("pancreas", "words", "pancreas"),
        ("spleen", "words", "spleen"),
        ("stomach", "words", "stomach"),
        ("colon", "words", "colon"),
        ("rectum", "words", "rectum"),
        ("esophagus", "words", "esophagus"),
        ("duodenum", "words", "duodenum"),
        ("small intestine", "words", "smallintestine"),
        ("cecum", "words", "cecum"),
        ("aorta", "words", "aorta"),
        ("prostate", "words", "prostate"),
        ("ovary", "words", "ovary"),
        ("testis", "words", "testis"),
        ("testis", "words", "testicul"),
        ("testis", "words", "testicular"),
        ("uterus", "words", "uterus"),
        ("cervix", "words", "cervix"),
        ("retina", "words", "retina"),
        ("skin", "words", "skin"),
        ("breast", "words", "breast"),
        ("gut", "words", "gut"),
        ("tonsil", "words", "tonsil"),
        ("placenta", "words", "placenta"),
        ("blood plasma", "words", "plasma"),
        ("blood serum", "words", "serum"),
        ("blood serum", "words", "lowserum"),
        ("blood", "words", "blood"),
        ("saliva", "words", "saliva"),
        ("urine", "words", "urine"),
        ("ascites", "words", "ascites"),
        ("tear fluid", "words", "tear"),
        ("milk", "words", "milk"),
        ("sputum", "words", "sputum"),
        ("feces", "words", "feces"),
        ("feces", "words", "stool"),
        ("sweat", "words", "sweat"),
        ("adipose tissue", "words", "adipose"),
        ("bone marrow", "words", "bonemarrow"),
        ("lymph node", "words", "lymphnode"),
        ("spinal cord", "words", "spinalcord"),
        ("frontal cortex", "words", "frontalcortex"),
        ("frontal cortex", "words", "cortex"),
        ("platelets", "words", "platelet"),
        ("monocytes", "words", "monocyte"),
        ("macrophage", "words", "macrophage"),
        ("fibroblast", "words", "fibroblast"),
        ("epithelial cell", "words", "epithelial"),
        ("erythrocyte", "words", "erythrocyte"),
        ("neutrophil", "words", "neutrophil"),
        ("oocyte", "words", "oocyte"),
        ("sperm", "words", "sperm"),
        ("liver", "words", "livernuc"),
        ("stem cells", "words", "ipsc"),
        ("stem cells", "words", "ipscs"),
        ("stem cells", "words", "hipsc"),
        ("stem cells", "words", "hipscs"),
        ("stem cells", "words", "hesc"),
        ("stem cells", "words", "hescs"),
        ("brain", "words", "dentategyrus"),
        ("brain", "words", "pyramidallayer"),
        ("brain", "words", "stratummoleculare"),
        ("brain", "words", "hippocampus"),
        ("brain", "words", "cerebellum"),
        ("brain", "words", "striatum"),
        ("brain", "words", "hypothalamus"),
        ("brain", "words", "amygdala"),
        ("brain", "words", "thalamus"),
        ("brain", "words", "midbrain"),
        ("heart", "words", "cardiac"),
        ("PBMCs", "anywhere", "pbmc"),
        ("skeletal muscle", "words", "myofibre"),
        ("skeletal muscle", "words", "myofiber"),
        ("skeletal muscle", "anywhere", "muscle"),
        ("sperm", "anywhere", "sperm"),
        ("liver", "anywhere", "hepatocyte"),
    ],
    "cell_part": [
        ("mitochondria", "words", "mitochondria"),
        ("mitochondria", "words", "mitochondrial"),
        ("mitochondria", "words", "mito"),
        ("nucleus", "words", "nucleus"),
        ("nucleus", "words", "nuclear"),
        ("nucleus", "words", "nuclei"),
        ("nucleus", "as written", "Nuc"),
        ("cytoplasm", "words", "cytoplasm"),
        ("cytoplasm", "words", "cytoplasmic"),
        ("cytoplasm", "as written", "Cyt"),
        ("membrane", "words", "membrane"),
        ("membrane", "as written", "MEMB"),
        ("ribosome", "words", "ribosome"),
        ("ribosome", "words", "ribosomal"),
        ("ribosome", "words", "ribosomes"),
        ("lysosome", "words", "lysosome"),
        ("lysosome", "words", "lysosomal"),
        ("lysosome", "words", "lysosomes"),
        ("peroxisome", "words", "peroxisome"),
        ("peroxisome", "words", "peroxisomal"),
        ("peroxisome", "words", "peroxisomes"),
    ],
    "disease": [
        ("healthy", "words", "healthy"),
        ("healthy", "words", "noncancerous"),
        ("healthy", "words", "benign"),
        ("healthy", "as written", "WT"),
        ("breast cancer", "as written", "BrCa"),
        ("cancer", "anywhere", "cancer"),
        ("cancer", "words", "tumor"),
        ("cancer", "words", "tumour"),
        ("cancer", "words", "carcinoma"),
        ("melanoma", "words", "melanoma"),
        ("glioblastoma", "words", "glioblastoma"),
        ("leukemia", "words", "leukemia"),
        ("lymphoma", "words", "lymphoma"),
        ("influenza", "words", "influenza"),
        ("COVID-19", "as written", "COVID"),
        ("COVID-19", "as written", "SARS"),
    ],
    "enrichment": [
        ("phospho-enrichment", "anywhere", "phosph"),
        ("phospho-enrichment", "words", "phos"),
        ("phospho-enrichment", "as written", "TiO"),
        ("ubiquitin-enrichment", "words", "ubiquitin"),
        ("ubiquitin-enrichment", "words", "ubiquityl"),
        ("acetyl-enrichment", "words", "acetyl"),
        ("glyco-enrichment", "words", "glyco"),
        ("glyco-enrichment", "words", "glycosyl"),
        ("SUMO-enrichment", "as written", "SUMO"),
    ],
    "fractionation": [
        ("True", "words", "frac"),
        ("True", "words", "fracc"),
        ("True", "words", "fraction"),
        ("True", "words", "fractionated"),
        ("True", "words", "fractionation"),
        ("True", "words", "fr"),
        ("True", "words", "fxn"),
        ("True", "words", "f"),
    ],
}
#: Fields of which all names are given, not the first alone.
COLLECTED = ("fragmentation",)
#: Fluids among the tissues above, which beat solid tissues.
RUN_FLUIDS = ("blood plasma", "blood serum", "blood", "saliva", "urine", "ascites", "tear fluid", "milk", "sputum", "feces", "sweat", "cerebrospinal fluid", "seminal plasma")
#: Short forms of cell lines in run names.
RUN_LINES = [("HEK293", "words", "hek"), ("Jurkat", "as written", "Jur")]

#: Fields of sample tables, by what the judging rules say of them.
TOLERANCE_FIELDS = ("precursor_mass_tolerance", "fragment_mass_tolerance")
ONE_VALUE_FIELDS = ("fragmentation_method", "cleavage_agent", "mass_analyzer", "ionization_type", "enrichment_method", "fractionation_method")
REGROUP_FIELDS = ("factor_value", "individual")
REPLICATE_FIELDS = ("biological_replicate", "technical_replicate", "fraction_identifier")
SAMPLE_FIELDS = ("age", "sex", "ethnicity", "individual", "cell_line", "tissue", "disease_state", "cell_type", "developmental_stage", "strain", "material_type")
DONOR_FIELDS = ("sex", "ethnicity", "age", "developmental_stage")
#: Pairs of fields that one fact may fill.
OVERLAP_PAIRS = (("enrichment_method", "modification"), ("age", "developmental_stage"), ("individual", "factor_value"))
#: Fields that claim comparisons, and words for the other side of one.
COMPARISON_FIELDS = ("experimental_design", "factor_value")
CONTROL_WORDS = ("control", "untreated", "no treatment", "vehicle", "dmso")
