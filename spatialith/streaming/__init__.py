"""spatialith.streaming"""
