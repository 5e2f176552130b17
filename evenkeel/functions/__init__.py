"""evenkeel.functions"""
