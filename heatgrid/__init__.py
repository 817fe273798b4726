"""Urban heat, land-cover and health-equity analytics on Spark."""
