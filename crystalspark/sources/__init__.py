"""crystalspark.sources"""
