"""spatialith.operators"""
