"""Dimension tables that results depend on."""

#: (name, latitude, longitude, romaji) in order.
PREFECTURES = [
    ("北海道", 43.0642, 141.3469, "Hokkaido"), ("青森県", 40.8244, 140.7400, "Aomori"), ("岩手県", 39.7036, 141.1527, "Iwate"), ("宮城県", 38.2688, 140.8721, "Miyagi"),
    ("秋田県", 39.7186, 140.1024, "Akita"), ("山形県", 38.2404, 140.3633, "Yamagata"), ("福島県", 37.7503, 140.4676, "Fukushima"), ("茨城県", 36.3418, 140.4468, "Ibaraki"),
    ("栃木県", 36.5658, 139.8836, "Tochigi"), ("群馬県", 36.3906, 139.0608, "Gunma"), ("埼玉県", 35.8617, 139.6455, "Saitama"), ("千葉県", 35.6073, 140.1233, "Chiba"),
    ("東京都", 35.6895, 139.6917, "Tokyo"), ("神奈川県", 35.4478, 139.6425, "Kanagawa"), ("新潟県", 37.9026, 139.0232, "Niigata"), ("富山県", 36.6959, 137.2114, "Toyama"),
    ("石川県", 36.5947, 136.6256, "Ishikawa"), ("福井県", 36.0652, 136.2216, "Fukui"), ("山梨県", 35.6642, 138.5686, "Yamanashi"), ("長野県", 36.6513, 138.1810, "Nagano"),
    ("岐阜県", 35.3912, 136.7223, "Gifu"), ("静岡県", 34.9769, 138.3831, "Shizuoka"), ("愛知県", 35.1815, 136.9066, "Aichi"), ("三重県", 34.7303, 136.5086, "Mie"),
    ("滋賀県", 35.0045, 135.8686, "Shiga"), ("京都府", 35.0116, 135.7681, "Kyoto"), ("大阪府", 34.6937, 135.5023, "Osaka"), ("兵庫県", 34.6913, 135.1830, "Hyogo"),
    ("奈良県", 34.6851, 135.8048, "Nara"), ("和歌山県", 34.2261, 135.1675, "Wakayama"), ("鳥取県", 35.5039, 134.2378, "Tottori"), ("島根県", 35.4723, 133.0505, "Shimane"),
    ("岡山県", 34.6551, 133.9195, "Okayama"), ("広島県", 34.3966, 132.4596, "Hiroshima"), ("山口県", 34.1859, 131.4714, "Yamaguchi"), ("徳島県", 34.0658, 134.5593, "Tokushima"),
    ("香川県", 34.3401, 134.0434, "Kagawa"), ("愛媛県", 33.8416, 132.7657, "Ehime"), ("高知県", 33.5597, 133.5311, "Kochi"), ("福岡県", 33.6064, 130.4183, "Fukuoka"),
    ("佐賀県", 33.2494, 130.2988, "Saga"), ("長崎県", 32.7448, 129.8737, "Nagasaki"), ("熊本県", 32.7898, 130.7417, "Kumamoto"), ("大分県", 33.2382, 131.6126, "Oita"),
    ("宮崎県", 31.9111, 131.4239, "Miyazaki"), ("鹿児島県", 31.5602, 130.5581, "Kagoshima"), ("沖縄県", 26.2124, 127.6809, "Okinawa"),
]
#: Query categories in order.
CATEGORIES = ["poi", "poi_brand", "poi_category", "address", "unsupported_query_location_intent", "broken_query", "others"]
#: (label, least count, most count) in order.
LONG_TAIL = [("1000+", 1000, None), ("500-999", 500, 999), ("100-499", 100, 499), ("10-99", 10, 99), ("2-9", 2, 9), ("1", 1, 1)]
USAGE_COLUMNS = ["bbox", "proximity", "poi_category", "poi_category_exclusions", "near", "navigation_profile"]
#: Level: (method, radius in metres, minutes).
DISTANCE_LEVELS = {
    "same_building": ("building_id", None, None),
    "adjacent": ("circle", 50, None),
    "roadside": ("both", 100, 1),
    "very_close": ("both", 150, 2),
    "nearby": ("both", 400, 5),
    "somewhat_nearby": ("both", 800, 10),
    "far": ("none", None, None),
}
#: Metres a minute.
SPEEDS = {"walking": 80, "cycling": 250, "driving": 500}
ROAD_RANK = {"motorway": 1, "motorway_link": 1, "trunk": 2, "trunk_link": 2, "primary": 3, "primary_link": 3, "secondary": 4, "secondary_link": 4, "tertiary": 5, "tertiary_link": 5, "street": 6, "street_limited": 6, "pedestrian": 7, "construction": 8, "track": 9, "service": 9, "path": 10}
RELEVANCE = {"definitely": 1.0, "probably": 0.7}
RELEVANCE_UNKNOWN = 0.4

#: Data issues of the feedback log and their labels, in order.
DATA_ISSUES = {"poi_missing": "poi coverage", "poi_attribute_wrong": "wrong poi", "poi_duplicate": "poi duplication", "address_missing": "address coverage", "address_wrong": "wrong address"}
MISSING_KINDS = {"general": "General", "bus": "Bus stop", "brand": "Brand", "parking_lot": "Parking lot"}
DATA_ACTIONS = {"add": "Add", "fix": "Fix", "delete": "Delete"}
USUAL_ACTION = {"poi_missing": "add", "poi_attribute_wrong": "fix", "poi_duplicate": "delete", "address_missing": "add", "address_wrong": "fix"}
#: A diagnosis' reason: (issue, kind of what is missing).
DIAGNOSED = {
    "poi coverage": ("poi_missing", "general"),
    "poi coverage (bus)": ("poi_missing", "bus"),
    "poi coverage (brand)": ("poi_missing", "brand"),
    "poi coverage (parking lot)": ("poi_missing", "parking_lot"),
    "poi freshness": ("poi_attribute_wrong", None),
    "address coverage": ("address_missing", None),
    "poi duplication": ("poi_duplicate", None),
    "wrong poi": ("poi_attribute_wrong", None),
    "wrong address": ("address_wrong", None),
}
UNCLEAR = ["unknown query", "too ambiguous query"]
RAIL_AND_OTHER = ["major_rail", "minor_rail", "service_rail", "ferry", "aerialway", "golf"]
ROAD_POINTS = ["junction", "roundabout", "mini_roundabout", "turning_circle", "turning_loop", "traffic_signals", "level_crossing", "intersection"]
#: Words of queries for kinds of places.
BUS_STOP_WORDS = ["バス停", "バス停留所", "停留所", "bus stop", "bus_stop"]
SHELTER_WORDS = ["避難所", "避難場所", "指定緊急避難所", "指定緊急避難場所", "避難施設", "shelter"]
BUILDING_WORDS = ["マンション", "アパート", "ビル", "邸", "タワー", "レジデンス", "ハイツ", "コーポ", "テラス", "荘", "館", "プレイス", "コート", "ガーデン", "ヴィラ", "パレス", "ハウス"]
LODGING_WORDS = ["ホテル", "宿", "旅館", "ホステル", "民宿", "ゲストハウス", "ロッジ", "宿泊"]
NATURAL = r"(公園|河川|運河|河口|[^\p{L}]?川$|川沿|海岸|海辺|海$|湖|池|沼|山$|山沿|丘|緑地|森|林|浜|ビーチ|滝|湿地|干潟|庭園|渓谷|岬|水辺|堤防|土手)"
