"""spatialith.plans"""
