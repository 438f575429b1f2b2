"""Fixed values that results depend on: alias lists, domains, weights and limits."""

# fixed values: verified concept spellings, canonical first
CONCEPTS = {
    "convective precipitation": ("convective precipitation", "convective rainfall", "convective rainfall likelihood", "afternoon convective precipitation"),
    "evapotranspiration": ("ET", "evapotranspiration"),
    "planetary boundary layer": ("PBL", "planetary boundary layer", "atmospheric boundary layer"),
    "precipitation": ("precipitation", "precipitation north of 18 n", "sahel precipitation"),
    "surface albedo": ("surface albedo", "surface albedo north of 18 n", "surface albedo increase 0.14 to 0.35"),
    "surface air temperature": ("surface air temperature", "surface temperature", "near-surface air temperature", "near-surface temperature"),
}
# fixed values: spellings of a state's direction
DIRECTIONS = {
    "increase": ("increase", "increased", "increasing", "higher", "rise", "rising", "enhancement", "enhanced", "warmer", "warming", "expand", "expanded", "expanding", "expansion", "increased from 0.14 to 0.35", "increased to 0.35"),
    "decrease": ("decrease", "decreased", "decreasing", "lower", "decline", "declining", "reduction", "reduce", "reduced", "cooler", "cooling", "decreases by approximately 40%", "decreased by 40%"),
    "strengthen": ("strengthen", "strengthened", "stronger", "intensify", "intensified"),
    "weaken": ("weaken", "weakened", "weaker", "diminish", "diminished"),
    "earlier": ("earlier", "advance", "advanced"),
    "later": ("later", "delay", "delayed"),
    "more_frequent": ("more frequent", "increased frequency", "more likely", "higher probability", "increased likelihood of occurrence"),
    "less_frequent": ("less frequent", "reduced frequency", "less likely", "lower probability"),
    "no_detectable_change": ("no detectable change", "no significant change", "insignificant effect", "null effect"),
    "on activated": ("on activated", "active", "activate", "activated", "activating"),
}
POLARITY = {"increase": 1, "decrease": -1, "no_detectable_change": 0}
UNSPECIFIED = ("affect", "affected", "change", "changed", "effect", "effects", "impact", "impacts", "report", "reported", "reporting", "reports")
DOMAIN_WEIGHTS = {"spatial_configuration": 1.0, "land_surface": 1.0, "hydrology": 1.0, "atmosphere": 1.0, "climate": 1.0, "substrate_terrain": 1.0, "other": 0.5}
# fixed values: phrases that show a spatial relation
SPATIAL_PHRASES = {
    "local_advection": ("propagate downwind", "downstream propagation", "background wind carries", "advected downwind", "upstream patch", "downstream patch"),
    "patch_gradient_edge": ("patch", "edge", "boundary", "gradient", "heterogeneity", "mosaic", "dry patch", "wet patch", "patch size"),
    "distance_decay": ("distance-decay", "annulus", "annuli", "halo", "within"),
    "orographic_windward_leeward": ("windward", "leeward", "ridge", "mountain barrier", "rain shadow"),
    "moisture_recycling_source_sink": ("precipitationshed", "moisture recycling", "evaporation source", "precipitation sink", "source region", "sink region", "terrestrial evaporation contribution"),
    "remote_teleconnection": ("teleconnection", "remote circulation response", "distant region", "intercontinental", "remote land-use impact"),
}
# fixed values: weights, limits and thresholds of retrieval
ALPHA, MISSING, BETA = 0.35, 0.25, 0.25
COARSE, RERANKED, CLAIMS_ANN, TRANSITIONS_ANN, RANKED = 100, 30, 100, 50, 200
SEEDS, MARGIN = 5, 0.05
WEIGHTS = {"context": 0.45, "mechanism": 0.20, "intervention": 0.15, "endpoint": 0.20}
MAX_LENGTH, BEAM, MAX_PATHS, LENGTH_PENALTY = 4, 40, 20, 0.08
TOP_PATHS, MAX_CLAIMS, BLOCKS_A_CLAIM, PER_FOCAL = 8, 24, 2, 3
BUDGET, HARD_BUDGET = 16_000, 20_000
BM25_K1, BM25_B = 1.5, 0.75
SECTION_TARGET, SECTION_MIN, SECTION_MAX = 6_500, 3_500, 8_000
NOTION_COSINE, CONTENT_COSINE, ENDPOINT_COSINE = 0.82, 0.88, 0.88
