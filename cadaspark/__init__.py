"""Land-parcel analytics on Spark: topology, record comparison, rules, zonal statistics, scoring."""
