"""Sources of raw records: local rows and files, feature services, and OpenStreetMap extracts."""
