"""Categories, place types, tag rules, themes, evidence weights, layers, register words. Order matters."""

# Query categories ("mixed" is for queries only).
CATEGORIES = ("history", "culture", "art", "scenic", "food", "civic", "mixed")
DISPLAY_ORDER = ("history", "culture", "art", "scenic", "food", "civic")

# Internal type -> (category, description, base significance, walking affinity, driving affinity).
TYPES = {
    "historic_site": ("history", "Historic site with strong local landscape context.", 68.0, 0.55, 0.9),
    "historic_district": ("history", "Historic district that helps explain settlement patterns and continuity.", 72.0, 0.75, 0.75),
    "museum": ("history", "Museum or interpretive site with clear historical context.", 64.0, 0.75, 0.75),
    "monument_memorial": ("history", "Monument or memorial with strong public memory value.", 62.0, 0.55, 0.6),
    "mural_public_art": ("art", "Public artwork that reads as part of the local cultural landscape.", 58.0, 0.9, 0.6),
    "gallery_art_space": ("art", "Art space with strong corridor-level cultural identity.", 56.0, 0.9, 0.6),
    "performance_cultural_venue": ("culture", "Cultural venue that signals local performance and public life.", 56.0, 0.75, 0.6),
    "neighborhood_corridor": ("culture", "Neighborhood corridor that expresses local identity at street level.", 60.0, 0.9, 0.6),
    "overlook_vista": ("scenic", "Viewpoint with a strong terrain and settlement read.", 60.0, 0.55, 0.9),
    "trail_river_access": ("scenic", "Landscape access point with ecological or scenic value.", 52.0, 0.75, 0.6),
    "civic_space_plaza": ("civic", "Civic space that helps explain the structure of public life.", 66.0, 0.9, 0.75),
    "infrastructure_landmark": ("civic", "Infrastructure trace that reveals labor, circulation, or water systems.", 64.0, 0.55, 0.9),
    "market_food_identity": ("food", "Identity-bearing market or food place with local distinctiveness.", 55.0, 0.55, 0.75),
    "ritual_religious_site": ("culture", "Ritual or religious site with strong cultural continuity.", 58.0, 0.55, 0.6),
    "landscape_feature": ("scenic", "Landscape feature with clear scenic or ecological legibility.", 57.0, 0.55, 0.9),
}
NO_DESCRIPTION = "No editorial description yet."
LOW_SIGNAL = ("survey", "resurvey", "confirm former", "fixme", "todo", "verify", "needs review", "not resurveyed", "check elevation")

# Tag rules (rule, internal type, required tags), first match wins, "*" is any value.
TAG_RULES = (
    ("marketplace", "market_food_identity", {"amenity": "marketplace"}),
    ("plaza_square", "civic_space_plaza", {"place": "square"}),
    ("pedestrian_plaza", "civic_space_plaza", {"highway": "pedestrian"}),
    ("viewpoint", "overlook_vista", {"tourism": "viewpoint"}),
    ("acequia_canal", "infrastructure_landmark", {"man_made": "canal"}),
    ("waterway_trace", "infrastructure_landmark", {"waterway": "*"}),
    ("railway_trace", "infrastructure_landmark", {"railway": "*"}),
    ("man_made_infrastructure", "infrastructure_landmark", {"man_made": "*"}),
    ("mural_artwork", "mural_public_art", {"tourism": "artwork", "artwork_type": "mural"}),
    ("memorial_artwork", "monument_memorial", {"tourism": "artwork", "artwork_type": "statue"}),
    ("gallery", "gallery_art_space", {"tourism": "gallery"}),
    ("museum", "museum", {"tourism": "museum"}),
    ("theatre", "performance_cultural_venue", {"amenity": "theatre"}),
    ("place_of_worship", "ritual_religious_site", {"amenity": "place_of_worship"}),
    ("park", "trail_river_access", {"leisure": "park"}),
    ("natural_feature", "landscape_feature", {"natural": "*"}),
    ("neighbourhood", "neighborhood_corridor", {"place": "neighbourhood"}),
    ("historic_district", "historic_district", {"historic": "district"}),
    ("historic_memorial", "monument_memorial", {"historic": "memorial"}),
    ("historic_monument", "monument_memorial", {"historic": "monument"}),
    ("historic_generic", "historic_site", {"historic": "*"}),
)
SUMMARY_TAGS = ("name", "historic", "tourism", "artwork_type", "amenity", "place", "railway", "waterway", "highway", "leisure", "natural", "man_made", "wikidata", "wikipedia")

# Themes -> (label, query-active, reason, badge).
THEMES = {
    "water": ("Water", True, "reveals acequia or water corridor traces", "water theme"),
    "rail": ("Rail", True, "reveals rail infrastructure or railyard corridor traces", "rail theme"),
    "public_memory": ("Public Memory", False, "reveals civic commemoration or staged public memory", "public memory theme"),
}
WATER_WORDS = ("acequia", "canal", "irrigation", "river", "water")
RAIL_WORDS = ("rail", "railway", "railroad", "railyard", "rail yard", "depot")
RAIL_NAMES = ("railway depot", "railroad depot", "railway station", "railroad station", "railyard", "rail yard", "rail trail")

# Evidence type -> (official, district, institutional, is heritage, district if the property is one).
EVIDENCE = {
    "historic_building_status": (0.9, 0.45, 0.0, True, 0.0),
    "district_membership": (0.6, 0.8, 0.0, True, 0.0),
    "boundary_membership": (0.35, 0.7, 0.0, False, 0.0),
    "institution_membership": (0.3, 0.0, 0.75, False, 0.0),
    "historic_designation": (1.0, 0.0, 0.0, True, 0.9),
    "state_historic_designation": (0.8, 0.0, 0.0, True, 0.75),
}

# Register names.
DROP_WORDS = ("the", "of", "de", "la", "del", "los", "las", "and", "y")
RELAXED_DROP_WORDS = ("historic", "historical", "national", "register", "listed", "district", "nhl", "landmark", "property", "properties", "resource", "resources", "additional", "documentation", "collection", "collections")
SAME_WORDS = {"st": "saint", "ft": "fort", "governors": "governor", "governor": "governor", "residence": "house", "home": "house", "casa": "house", "chapels": "chapel", "churches": "chapel", "capilla": "chapel"}
NAME_STOP_WORDS = ("the", "of", "de", "la", "and", "museum")

# Score weights.
WEIGHTS = {"significance": 30.0, "quality": 10.0, "mode": 8.0, "official": 8.0, "district": 5.0, "institutional": 4.0, "generic": 10.0}
HISTORY_ANCHORS = ("palace of the governors", "the santa fe plaza", "santa fe plaza", "de vargas street house")

# Region -> (south, west, north, east), country.
REGIONS = {"santa-fe": ((35.612, -106.083, 35.744, -105.854), "usa")}

# Map layers (source, layer number, evidence type, geometry, name field, label without one, confidence).
LAYERS = (
    ("city_gis_museums", 9, "institution_membership", "point", "DEPARTMENT", "Museums", 0.85),
    ("city_gis_public_art", 12, "institution_membership", "point", "NAME", "Public Art", 0.75),
    ("city_gis_place_of_worship", 11, "institution_membership", "point", "NAME", "Places of Worship", 0.7),
    ("city_gis_historic_districts", 118, "district_membership", "polygon", None, "Historic Districts", 0.8),
    ("city_gis_historic_building_status", 125, "historic_building_status", "polygon", "HBSTAT", "Historical Buildings Status", 0.9),
    ("city_gis_plaza_park", 91, "boundary_membership", "polygon", None, "Plaza Park", 0.85),
    ("city_gis_railyard_boundary", 93, "boundary_membership", "polygon", None, "The Railyard", 0.85),
)

# Seed aliases by canonical name (alias, kind, confidence).
SEED_ALIASES = {
    "The Santa Fe Plaza": (("Santa Fe Plaza", "common", 0.98),),
    "Palace of the Governors": (("Palace of the Governor's", "register_variant", 0.96),),
    "San Miguel": (
        ("San Miguel Chapel", "common", 0.99),
        ("Chapel of San Miguel", "register_variant", 0.97),
        ("San Miguel Mission", "historic", 0.96),
        ("San Miguel Mission Church", "historic", 0.95),
    ),
    "Barrio de Analco Historic District": (
        ("Barrio de Analco", "common", 0.95),
        ("Barrio de Analco National Register Historic District", "register_variant", 0.98),
        ("Barrio de Analco National Register Historic District NHL", "register_variant", 0.98),
    ),
    "De Vargas Street House": (("Oldest House", "common", 0.97), ("Oldest House Museum", "common", 0.96)),
}

# Suites of evaluation cases; one without names holds every case.
SUITES = {
    "core-product": ("nearby-plaza-history", "nearby-canyon-art", "nearby-railyard-rail", "route-historic-center-driving", "route-railyard-rail", "route-arts-corridor-walk"),
    "rail-smoke": ("nearby-railyard-civic", "nearby-railyard-rail", "route-railyard-civic", "route-railyard-rail"),
    "water-smoke": ("nearby-acequia-water", "nearby-plaza-water-empty", "route-acequia-water"),
    "empty-result-guardrails": ("nearby-plaza-water-empty", "nearby-plaza-rail-empty", "nearby-downtown-scenic-empty", "route-downtown-scenic-empty"),
    "nearby-smoke": (
        "nearby-acequia-water", "nearby-plaza-history", "nearby-canyon-art", "nearby-railyard-civic", "nearby-railyard-rail", "nearby-plaza-water-empty", "nearby-plaza-rail-empty", "nearby-downtown-scenic-empty",
    ),
    "route-smoke": ("route-acequia-water", "route-historic-center-driving", "route-railyard-civic", "route-railyard-rail", "route-arts-corridor-walk", "route-downtown-scenic-empty"),
    "all-fixtures": (),
}
