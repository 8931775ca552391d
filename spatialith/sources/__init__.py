"""spatialith.sources"""
