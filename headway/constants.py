"""Constants that decide results, in one place. Fixed values of the domain."""

SERVICE_BOX = (-2.36, 53.40, -2.16, 53.53)  # west, south, east, north; both ends belong
FUTURE_TOLERANCE_S = 120
MAX_XML_BYTES = 80_000_000
FRESH_S, AGEING_S, EXPIRY_S, PUBLICATION_STALE_S = 60, 150, 900, 120
TRAIL_POINTS, TRAIL_S, KEPT_FIXES, AGE_CAP_S = 6, 240, 12, 900
REPLAY_LEAD_MS, REPLAY_LAG_MS = 120_000, 30_000
PATTERN_MIN_STOPS, HORIZON_DAYS, SHRINK_FLOOR = 5, 14, 0.5
MATCH_MAX_M, AMBIGUITY_M = 500.0, 60.0
SHAPE_P95_M, SHAPE_MIN_REPORTS, SHAPE_WINDOW, WITHIN_M, SHARED_M = 35.0, 30, 10, 30.0, 10.0
MAPPING_VERSION, COORD_TOLERANCE_DEG, GEOMETRY_TOLERANCE_M = 2, 1.5e-5, 30.0
PASSAGE_GAP_S, OFF_ROAD_M, MIN_REPORTS, BACKWARDS_M = 60.0, 40.0, 6, 5.0
WALK_M, STOPS_NEAR, DIRECT_CANDIDATES = 900.0, 250, 24
CHANGE_CANDIDATES, TRANSFER_M, DETOUR, WALK_M_PER_MIN = 48, 350.0, 1.3, 80.0
RIDE_M_PER_STOP, CHANGE_PENALTY_M, CHANGE_ALLOWANCE_S, DIRECT_REACH_M, NEARER_M = 450.0, 700.0, 120, 450, 200
DIRECT_WINDOW_S, CHANGE_WINDOW_S, BOARD_LIMIT, BOARD_GRACE_S, BOARD_WINDOW_S = 180 * 60, 90 * 60, 8, 60, 180 * 60
LATER_S, DIRECT_TIMES, FIRST_BUSES = 26 * 3600, 6, 12
GRID_LAT, GRID_LON = 0.004, 0.006
DWELL_S, SPEED_WINDOW_S, STANDING_M_S, NEAR_M, MAX_M_S = 20, 180, 1.0, 1000.0, 20.0
SAMPLE_S, HOLD_STALE_S, BIN_MIN, BOOTSTRAP_SEED = 5, 150, 0.05, 20260929
POLL_WAIT_S, SHOWN_MIN, HORIZON_S, LEAST_LEAD_S = 10, (2, 10), 1200, 60
LONDON = "Europe/London"

# Four Earth models, each used where the measure it is compared with was made with it.
RADIUS_M, MEAN_RADIUS_M, DEGREE_M, PLAIN_DEGREE_M = 6_371_000.0, 6_371_008.8, 111_320.0, 111_195.0

#: Words that place names share and that say nothing about which place is meant.
GENERIC_PLACE_WORDS = ("bus", "station", "interchange", "the", "stop", "stand", "terminus")
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
