"""headway: a Spark-native analytics engine for vehicle-position feeds and registered timetables."""
